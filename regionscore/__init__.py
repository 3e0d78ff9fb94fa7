"""regionscore package."""
