"""Token-efficiency spans of runs in one case and of short runs."""

import random
import string

import public_tokenizers

from regionscore.llm import secret_scan

ALPHABETS = {20: (string.ascii_lowercase, string.ascii_uppercase), 16: (string.ascii_letters + string.digits,)}
WORDS = ["internationalization_settings", "MAXIMUM_CONNECTION_RETRIES", "user_id_of_the_day", "a_b_c_d_e_f_g_h_i_j_k", "=" * 30, "-_" * 12,
         "2024-05-06T07-08-09-101112", "getElementByIdentifier", "uncharacteristically", "responsibilities", "12345678901234567"]


def test_one_case_and_short_runs(spark):
    rng = random.Random(3)
    runs = ["".join(rng.choices(a, k=n)) for n, alphabets in ALPHABETS.items() for a in alphabets for _ in range(300)]
    texts = [*WORDS, *runs]
    docs = spark.createDataFrame([(i, f"see {x} there") for i, x in enumerate(texts)], "doc_id long, text string")
    got = secret_scan.find_secrets(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    found = {r.row.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in got}
    assert [texts[i] for i in range(len(WORDS)) if found[i]] == []
    for k, share in [(0, 0.95), (300, 0.95), (600, 0.85)]:
        hits = [found[len(WORDS) + k + i] == [("token", 4, 4 + len(runs[k + i]))] for i in range(300)]
        print(k, sum(hits))
        assert sum(hits) >= share * 300
