"""Operator 8: remove globally repeated runs of lines, cut at content-defined places.

A text is cut into lines, after each line feed and after each end of a sentence
or clause that a space follows, so that a passage inside a paragraph is a run of
lines as well, and a passage of fifty words is long enough to hold whole chunks;
lines keep their separators, and joined they are the text. A line of more than
``LONG_LINE`` bytes (lists, text without such marks) is cut again between words,
or after characters of scripts without spaces. A rolling hash over the hashes of
two lines is taken at every line, and a chunk ends where it has a strict local
minimum; from the second on, equal lines in a row count with their place in that
row, so that it has minima too. Such places depend on a few lines nearby (and
the start of a row of equal lines) only, so that an insertion shifts no later
boundary, and every chunk but a text's first and last has two lines or more.
Long lines are cut by the same rule over their words.

A chunk of at least two lines that is repeated anywhere in the corpus stays at
its first place (smallest doc_id, null last, then scan order); at all others it
is a later copy. Neighbouring later copies of a document are one run, and runs
are removed. A caller who wants common phrases to stay sets ``min_words``, which
holds for a run, however few words each of its chunks has. Hashes only propose
repeats: repeated chunks are grouped by their bytes before any is removed, so
that two texts with one hash are never taken for each other. A run's first and
last lines share chunks with its surroundings, so each run is then extended line
by line, up to the first line that differs from those beside the first place of
its outer chunk, and not into a chunk that stays as a first place. Lines are
compared through the one chunk behind that place and the two before it. Nothing
is lost by that: a boundary rests on the line behind it and three before it, so
that where all those are equal, so is the boundary, and the chunk is a copy
itself (only in a row of equal lines a boundary also rests on where it starts).

Shuffles: a skinny table of chunk hashes (pre-aggregated, so that a chunk in a
third of all documents is one row per task), the lines by row number, the texts
of repeated chunks, and the lines beside runs. No Python runs on the executors.

Defined results: null stays null, empty stays empty; a text of one line is never
changed; a text all of whose chunks are repeats becomes empty, its row stays;
repeated rows count as repeats of each other; n_chars, where it is given, is that
of the new text. Rows are numbered once, in a table with their lines in the shared
folder, which every later step reads, so that ``docs`` may come in another order
or in other partitions each time it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionscore.llm.common import shared_table

#: Scripts without spaces (Thai to Lao, Myanmar, Khmer, kana, Han): each character counts as a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
UNIT = rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]+"
LINE_END = r"(?<=\n)|(?<=[.!?,;:\u060c\u061b\u061f\u06d4] )|(?<=[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])"
#: The same ends as a search, and not at the end of a text. ``LAST_LOW`` is for texts without characters from ``HIGH``
#: on, the first mark beyond ASCII: Java tests its class in one step, and one of many ranges range by range.
LAST_LOW = r"[\n.!?,;:](?:(?<=\n)| )(?!\z)"
LAST = (r"[[^A-\u060b]&&[\n.!?,;:[[^\x00-\x7f]&&[\u060c\u061b\u061f\u06d4\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f]]]]"
        r"(?:(?<![.!?,;:\u060c\u061b\u061f\u06d4])| )(?!\z)")
HIGH = "[\u060c-\U0010ffff]"
#: What a long line is cut into: a word and the white space after it. ``split`` would compile a pattern for each line.
#: Characters below the first of ``UNSPACED`` are taken first, by a single range; no part gives characters back.
INNER = rf"[!-\u0dff[^\x20\x09-\x0D{UNSPACED}]]*+"
PIECE = rf"[!-\u0dff]*+(?:[\x20\x09-\x0D]++|{INNER}(?:[\x20\x09-\x0D]++|[{UNSPACED}]))|(?!\z){INNER}"
#: Bytes. A line of over fifty words has more, and is cut between words.
LONG_LINE = 96
#: Stands between the lines of stored texts; texts that hold it are stored as arrays.
MARK = "\x01"


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rolled(h: Column) -> Column:
    """The rolling hash of a sequence with hashes ``h``, which is used more than once; equal neighbours count with their
    place in their row."""
    def tied(h):
        rows = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (i == 0) | (F.get(h, i) != F.get(h, i - 1)))
        place = lambda rows: F.flatten(F.transform(rows, lambda s, j: F.sequence(
            F.lit(0), F.coalesce(F.get(rows, j + 1), F.size(h)) - s - 1)))
        return let(rows, lambda f: F.zip_with(h, place(f), lambda x, k: F.when(k == 0, x).otherwise(F.xxhash64(x, k))))

    rolling = lambda t: F.transform(t, lambda x, i: F.xxhash64(x, F.get(t, i - 1)))
    # null beside an equal one: only then the places in rows are worked out
    plain = F.transform(h, lambda x, i: F.when((i == 0) | (x != F.get(h, i - 1)), F.xxhash64(x, F.get(h, i - 1))))
    return let(plain, lambda r: F.when(F.exists(r, F.isnull), let(tied(h), rolling)).otherwise(r))


def starts_at(r: Column, i: Column) -> Column:
    """Whether a chunk starts at i > 0: one ends at a strict local minimum of the rolling hash. Null for i = 1."""
    return (F.get(r, i - 1) < F.get(r, i - 2)) & (F.get(r, i - 1) < F.get(r, i))


def starts_of(h: Column) -> Column:
    """Where the chunks of a sequence with hashes ``h`` start. ``h`` is used more than once."""
    places = lambda r: F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda i: (i == 0) | starts_at(r, i))
    return F.when(F.size(h) > 0, let(rolled(h), places)).otherwise(F.array().cast("array<int>"))


def words_of(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(PIECE), F.lit(0))


def cut_line(line: Column) -> Column:
    """A long line as several, cut between words."""
    def joined(words, starts):
        end = lambda j: F.coalesce(F.get(starts, j + 1), F.size(words))
        return F.transform(starts, lambda s, j: F.array_join(F.slice(words, s + 1, end(j) - s), ""))

    return let(words_of(line), lambda w: let(
        F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(starts_of(h), lambda s: joined(w, s))))


def mark_line(line: Column) -> Column:
    """The same, with marks between them."""
    marked = lambda words, r: F.array_join(F.transform(words, lambda x, i: F.when(
        starts_at(r, i), F.concat(F.lit(MARK), x)).otherwise(x)), "")
    return let(words_of(line), lambda w: let(
        F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(rolled(h), lambda r: marked(w, r))))


def is_odd(text: Column) -> Column:
    return F.contains(text, F.lit(MARK))


def marked_lines(text: Column) -> Column:
    """Lines with their separators, marks between them; none is empty (the end of a text that ends a line would be), so
    that equal chunks are equal arrays. For texts that hold no mark."""
    low = (F.octet_length(text) == F.length(text)) | ~F.regexp_like(text, F.lit(HIGH))
    ends = F.when(low, F.regexp_replace(text, LAST_LOW, "$0" + MARK)).otherwise(F.regexp_replace(text, LAST, "$0" + MARK))
    lines = F.split(ends, MARK)
    return F.array_join(F.transform(lines, lambda x: F.when(F.octet_length(x) > LONG_LINE, mark_line(x)).otherwise(x)), MARK)


def odd_lines(text: Column) -> Column:
    """The same lines as an array, for any text."""
    lines = F.filter(F.split(text, LINE_END), lambda x: x != "")
    return F.flatten(F.transform(lines, lambda x: F.when(F.octet_length(x) > LONG_LINE, cut_line(x)).otherwise(F.array(x))))


def unmarked(marked: Column) -> Column:
    return F.when(marked == "", F.array().cast("array<string>")).otherwise(F.split(marked, MARK))


def lines_of(text: Column) -> Column:
    """The lines of any text."""
    return F.when(is_odd(text), odd_lines(text)).otherwise(let(marked_lines(text), unmarked))


def with_lines(rows: DataFrame) -> DataFrame:
    """``rows`` with lines, from marked or odd. Called after a shuffle, since arrays are larger than texts."""
    return rows.withColumn("lines", F.coalesce("odd", unmarked(F.col("marked"))))


def chunked(rows: DataFrame, lines: Column) -> DataFrame:
    """``rows`` with ``lines`` and chunks: an array of (start, len, back, ahead, hash).

    back and ahead are the lines of the two chunks before and of the one behind.

    Every array is a column of its own that later ones use more than once, so
    that the optimizer doesn't evaluate it again inside a lambda.
    """
    out = (rows.withColumn("lines", lines)
           .withColumn("h", F.transform("lines", lambda x: F.xxhash64(x)))
           .withColumn("starts", starts_of(F.col("h"))))
    end = lambda j: F.coalesce(F.get("starts", j + 1), F.size("h"))
    length = lambda s, j: end(j) - s
    # slice would copy all of h for each chunk here, as it isn't in generated code
    own = lambda s, j: F.transform(F.sequence(s, end(j) - 1), lambda i: F.get("h", i))
    return out.withColumn("chunks", F.transform("starts", lambda s, j: F.struct(
        s.alias("start"), length(s, j).alias("len"), (s - F.get("starts", F.greatest(j - 2, F.lit(0)))).alias("back"),
        (end(j + 1) - end(j)).alias("ahead"),
        F.xxhash64(own(s, j), length(s, j)).alias("hash"))))


def extended(span: Column) -> Column:
    """The places of a span's lines, and of those beside it that equal the lines beside its source."""
    def equal(at):
        """How many lines from at(0) on equal those of the source, at(1) and so on."""
        differ = lambda k: ~F.coalesce(at(k), F.lit(False))
        return F.array_min(F.filter(F.sequence(F.lit(0), F.size(span.beside)), differ))

    before = equal(lambda k: F.get("lines", span.start - 1 - k) == F.get(span.beside, F.size(span.beside) - 1 - k))
    after = equal(lambda k: F.get("lines", span.end + k) == F.get(span.beside, k))
    return F.when(span.side < 0, F.sequence(span.start - before, span.end - 1)).otherwise(
        F.sequence(span.start, span.end + after - 1))


def dedup_lines(docs: DataFrame, min_words: int = 0, text: str = "text", doc_id: str = "doc_id",
                n_chars: str | None = "n_chars") -> DataFrame:
    """One row per row of ``docs``: row (a struct of its columns, text cleaned), lines_removed, words_removed."""
    others = [F.lit(None).cast("string").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    whole, odd = F.col("text"), is_odd(F.col("text"))
    numbered = (
        docs.select(F.struct(*others).alias("row"), F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("rid"))
        .select("row", "rid", F.when(~odd, marked_lines(whole)).alias("marked"), F.when(odd, odd_lines(whole)).alias("odd")))
    rows = shared_table(chunked(with_lines(numbered), F.col("lines")).select("row", "rid", "marked", "odd", "chunks"), "rows", "zstd")
    skinny = rows.select("rid", F.explode("chunks").alias("c")).filter("c.len >= 2").select("rid", "c.*")
    # a table of its own: the join then has a plain exchange on both sides, whose hot hashes Spark splits
    repeated = shared_table(skinny.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "hashes")
    proposed = shared_table(skinny.join(repeated, "hash"), "repeats", "zstd")

    # byte comparison: the repeated chunks with their text, grouped by it
    place = ["start", "len", "back", "ahead"]
    per_row = proposed.groupBy("rid").agg(F.collect_list(F.struct(*place, "hash")).alias("cs"))
    texts = (with_lines(rows.select(F.col("row")[doc_id].alias("doc"), "rid", "marked", "odd").join(per_row, "rid"))
             .withColumn("c", F.explode("cs"))
             .select("doc", "rid", "c.*", F.array_join(F.slice("lines", F.col("c.start") + 1, F.col("c.len")), "").alias("chunk")))
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "rid", "start", "back", "ahead")).alias("first")
    same = (texts.groupBy("hash", "chunk").agg(F.count("*").alias("n"), first)
            .withColumn("texts", F.count("*").over(Window.partitionBy("hash"))))
    words = F.regexp_count("chunk", F.lit(UNIT)) if min_words > 0 else F.lit(0)  # no floor asks for none
    same = shared_table(same.filter("n > 1").withColumn("words", words), "classes")
    # nearly always one text has the hash, and the hash tells the class; else the text does
    alone = proposed.join(same.filter("texts = 1").select("hash", "words", "first"), "hash")
    shared = same.filter("texts > 1").select("hash", "chunk", "words", "first")
    copies = alone.select("rid", "start", "len", "words", "first")
    if not shared.isEmpty():
        copies = copies.union(texts.join(shared, ["hash", "chunk"]).select("rid", "start", "len", "words", "first"))
    later = ~((F.col("rid") == F.col("first.rid")) & (F.col("start") == F.col("first.start")))
    # the lines between a row's later copies up to here are as many for all chunks of a run, and more for the next run
    between = F.col("start") + F.col("len") - F.sum("len").over(Window.partitionBy("rid", "later").orderBy("start"))
    source = lambda line, reach: F.struct(F.col("first.rid").alias("source"), line.alias("line"), F.col(reach).alias("reach"))
    spans = shared_table(
        copies.withColumn("later", later).withColumn("run", between).groupBy("rid", "later", "run")
        .agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("len")).alias("end"), F.sum("words").alias("words"),
             F.min_by(source(F.col("first.start"), "first.back"), "start").alias("left"),
             F.max_by(source(F.col("first.start") + F.col("len"), "first.ahead"), "start").alias("right"))
        .filter(~F.col("later") | (F.col("words") >= min_words)), "runs")
    edges = (spans.filter("later").withColumn("edge", F.explode(F.array(
        F.struct(F.lit(-1).alias("side"), "left.*"), F.struct(F.lit(1).alias("side"), "right.*"))))
        .select("rid", "start", "end", "edge.*"))
    asked = (edges.select("source", "side", "line", "reach").distinct()
             .groupBy("source").agg(F.collect_list(F.struct("side", "line", "reach")).alias("asked")))
    near = F.slice("lines", F.when(F.col("side") < 0, F.col("line") - F.col("reach")).otherwise(F.col("line")) + 1, F.col("reach"))
    beside = shared_table(with_lines(rows.select(F.col("rid").alias("source"), "marked", "odd").join(asked, "source")).withColumn("a", F.explode("asked"))
                          .select("source", "a.*", "lines").select("source", "side", "line", near.alias("beside")), "beside")
    span = ["rid", "start", "end", "side", "beside"]
    stay = spans.filter("not later").select("rid", "start", "end", F.lit(0).alias("side"), F.lit(None).cast("array<string>").alias("beside"))
    drops = (edges.join(beside, ["source", "side", "line"]).select(span).union(stay)
             .groupBy("rid").agg(F.collect_list(F.struct(*span[1:])).alias("spans"))
             .filter(F.exists("spans", lambda x: x.side != 0)))

    places = lambda picked, of: F.flatten(F.transform(F.filter("spans", picked), of))
    # texts that lose nothing are not split into lines again
    joined = (rows.drop("chunks").join(drops, "rid", "left")
              .withColumn("lines", F.when(F.col("spans").isNotNull(), F.coalesce("odd", unmarked(F.col("marked")))))
              .withColumn("gone", F.array_except(places(lambda x: x.side != 0, extended),
                                                 places(lambda x: x.side == 0, lambda x: F.sequence(x.start, x.end - 1)))))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")),
                       lambda i: F.get("lines", i))
    whole = F.coalesce(F.array_join("odd", ""), F.replace("marked", F.lit(MARK), F.lit("")))
    cleaned = F.when(F.col("gone").isNull(), whole).otherwise(F.array_join(kept, ""))
    removed = F.coalesce(F.size("gone"), F.lit(0))
    out = joined.select("row", F.when(F.col("gone").isNull(), 0).otherwise(removed).alias("lines_removed"),
                        cleaned.alias("cleaned"))
    row = F.col("row").withField(f"`{text}`", F.col("cleaned"))
    if n_chars and n_chars in docs.columns:
        row = row.withField(f"`{n_chars}`", F.when(F.col("lines_removed") > 0, F.length("cleaned"))
                            .otherwise(F.col("row")[n_chars]).cast(docs.schema[n_chars].dataType))
    return out.select(row.alias("row"), "lines_removed")
