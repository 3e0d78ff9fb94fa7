"""The queries opN_* over the documents table, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionscore.llm import merkle, token_count
from regionscore.llm.bpe import encode_documents
from regionscore.llm.collocations import collocations
from regionscore.llm.common import crc_mod, documents
from regionscore.llm.conversation_repair import damaged, repaired_or_empty
from regionscore.llm.line_dedup import dedup_lines
from regionscore.llm.mixing import mix
from regionscore.llm.ngram_lm import score_texts
from regionscore.llm.quality_model import score, train
from regionscore.llm.quality_rules import judge
from regionscore.llm.secret_scan import find_secrets
from regionscore.llm.sharding import assign_shards
from regionscore.llm.simhash import fingerprint_hex, near_duplicates
from regionscore.sources.tables import read_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies, on the driver and on every executor."""
    import public_tokenizers
    return public_tokenizers.path(name)


def quality_model(spark, sf_dir):
    """The classifier of labels.quality, from the rows whose crc32(doc_id) mod 3 is not 1."""
    labels = read_table(spark, sf_dir, "labels").filter(crc_mod(F.col("doc_id"), 3) != 1)
    labels = labels.select("doc_id", F.col("quality").alias("label"))
    return train(documents(spark, sf_dir).select("doc_id", "text"), labels)


@query
def op1_quality(spark, sf_dir):
    """Quality score of every text by gated attention over its passages."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = score(docs, quality_model(spark, sf_dir))
    return found.select("row.doc_id", (crc_mod(F.col("row.doc_id"), 3) == 1).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op2_bpe(spark, sf_dir):
    """Every text encoded by the merge automaton and decoded again."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = encode_documents(docs, tokenizer_path("word_bpe_49k.json"))
    return out.select("row.doc_id", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op3_merkle(spark, sf_dir):
    """Merkle roots of every text and its edited text, and how like they and the next text are."""
    docs = merkle.with_successor(documents(spark, sf_dir).select("doc_id", "text"))
    docs = docs.withColumn("edited", merkle.edited_text("text", "next_text"))
    docs = merkle.with_tree(docs, "edited", "edited_").withColumn("diff", merkle.differing_paragraphs("own_", "edited_"))
    return docs.select(
        "row.doc_id", F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("own_root").alias("fingerprint"), F.col("edited_root").alias("edited_fingerprint"),
        merkle.likeness("own_", "edited_").alias("near_edited"), merkle.likeness("own_", "next_").alias("near_next"),
        F.size("diff").cast("long").alias("n_diff_paragraphs"), F.get("diff", F.lit(0)).cast("long").alias("first_diff_paragraph"))


ORACLE["op3_merkle"] = r"""
WITH RECURSIVE o AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, text) AS k,
         count(*) OVER () AS n FROM documents),
p AS (SELECT a.doc_id, a.k, a.text, b.text AS nxt, CAST(length(a.text) AS BIGINT) AS n_chars
      FROM o a JOIN o b ON b.k = a.k % a.n + 1),
e AS (SELECT *, substr(text, 1, n_chars - n_chars // 3) || substr(nxt, 1, n_chars // 3) AS edited FROM p),
t AS (SELECT k, 'own' AS kind, text AS t FROM e UNION ALL SELECT k, 'edited', edited FROM e UNION ALL SELECT k, 'next', nxt FROM e),
s AS (SELECT k, kind, unnest(string_split(t, chr(10) || chr(10))) AS s, generate_subscripts(string_split(t, chr(10) || chr(10)), 1) AS si FROM t),
q AS (SELECT k, kind, si, unnest(string_split(s, chr(10))) AS q, generate_subscripts(string_split(s, chr(10)), 1) AS qi FROM s),
l AS (SELECT k, kind, si, qi, list_transform(
        regexp_extract_all(q, '[ 	-
]*(?:[^ 	-
]*[^ 	-
.!?][ 	-
]+){0,3}[^ 	-
]+[ 	-
]*|[ 	-
]+'),
        lambda x: CAST('0x' || substr(md5(x), 1, 15) AS BIGINT)) AS l FROM q),
h AS (SELECT k, kind, si, qi, l, CAST('0x' || substr(md5('p' || len(l) || ':' || list_aggregate(l, 'string_agg', ',')), 1, 15) AS BIGINT) AS h0,
             CAST('0x' || substr(md5('p0:'), 1, 15) AS BIGINT) AS h1, len(l) AS n FROM l),
hs AS (SELECT k, kind, si, list(CASE WHEN n = 0 THEN h1 ELSE h0 END ORDER BY qi) AS ps FROM h GROUP BY k, kind, si),
r AS (SELECT k, kind, 'd' || count(*) || ':' || string_agg(CAST(CAST('0x' || substr(md5('s' || len(ps) || ':' || list_aggregate(ps, 'string_agg', ',')), 1, 15) AS BIGINT) AS VARCHAR), ',' ORDER BY si) AS r,
             flatten(list(ps ORDER BY si)) AS ps FROM hs GROUP BY k, kind),
d AS (SELECT k, kind, list_distinct(flatten(list(l))) AS ls FROM h GROUP BY k, kind),
x AS (SELECT r.k, r.kind, sha256(r.r) AS root, r.ps, d.ls FROM r JOIN d ON r.k = d.k AND r.kind = d.kind),
c AS (SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, a.root AS fingerprint, b.root AS edited_fingerprint,
             a.ls AS al, b.ls AS bl, c.ls AS cl, c.root AS nr,
             list_filter(range(greatest(len(a.ps), len(b.ps))), lambda i: a.ps[i + 1] IS DISTINCT FROM b.ps[i + 1]) AS diff
      FROM e JOIN x a ON a.k = e.k AND a.kind = 'own' JOIN x b ON b.k = e.k AND b.kind = 'edited' JOIN x c ON c.k = e.k AND c.kind = 'next')
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN fingerprint = edited_fingerprint THEN 1.0::DOUBLE WHEN len(al) + len(bl) = 0 THEN 0.0::DOUBLE
       ELSE least(2.0::DOUBLE * len(list_intersect(al, bl)) / (len(al) + len(bl)), 0.999999::DOUBLE) END AS near_edited,
  CASE WHEN fingerprint = nr THEN 1.0::DOUBLE WHEN len(al) + len(cl) = 0 THEN 0.0::DOUBLE
       ELSE least(2.0::DOUBLE * len(list_intersect(al, cl)) / (len(al) + len(cl)), 0.999999::DOUBLE) END AS near_next,
  CAST(len(diff) AS BIGINT) AS n_diff_paragraphs, CAST(diff[1] AS BIGINT) AS first_diff_paragraph
FROM c
"""


@query
def op4_simhash(spark, sf_dir):
    """SimHash of three-word shingles, and components of fingerprints at three or fewer differing bits."""
    found = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), shingle=3, radius=3)
    return found.select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op5_ngram_lm(spark, sf_dir):
    """Log10 probability of every text under a model of the texts whose crc32(doc_id) mod 10 is not 0."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return score_texts(docs, crc_mod(F.col("doc_id"), 10) == 0)


@query
def op6_quality_rules(spark, sf_dir):
    """Word and line statistics of every text, and the verdict of the rules with certified cutoffs."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return judge(docs, labels).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                      "base_failed", "kept", F.concat_ws(",", "failed").alias("failed_rules"))


#: The separator: an id that the vocabulary leaves free.
END_OF_DOCUMENT = 50256


@query
def op7_token_counts(spark, sf_dir):
    """Tokens of every document, by a scan of flat token files of all texts for separators."""
    import public_tokenizers
    docs = documents(spark, sf_dir).select("doc_id", "text")
    blocks = token_count.pack(docs, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, END_OF_DOCUMENT)
    return token_count.token_counts(blocks, END_OF_DOCUMENT, "doc_ids").select("doc_id", "n_tokens")


@query
def op8_line_dedup(spark, sf_dir):
    """Each document with the lines that the removal of repeated chunks took, and its new text."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "n_chars")
    return dedup_lines(docs).select("row.doc_id", "row.text", "row.n_chars", "lines_removed")


@query
def op9_secrets(spark, sf_dir):
    """Secrets in every text, by patterns and by characters a token."""
    import public_tokenizers
    found = find_secrets(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path("byte_bpe_50k.tiktoken"),
                         public_tokenizers.PATTERN)
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                               s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "token")
    return found.select("row.doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
                        F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


@query
def op10_mix_sources(spark, sf_dir):
    """Mix all documents: 150 % of all words, sources weighted 3, 1, 2 in turn, two epochs at most."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return mix(docs).select("row.doc_id", "size", "source_size", "target", "taken")


ORACLE["op10_mix_sources"] = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS sk,
         md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT sk, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY sk),
w AS (
  SELECT *, CAST([3, 1, 2][((row_number() OVER (ORDER BY sk) - 1) % 3) + 1] AS DOUBLE) AS w,
         source_size * 2.0::DOUBLE AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget FROM s),
l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, sk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level0 FROM w),
v AS (SELECT arg_min(level0, cap / w) AS level FROM l WHERE NOT level0 >= cap / w),
t AS (SELECT sk, source_size, w, budget, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target
      FROM l, v),
p AS (SELECT d.*, t.source_size, t.target, t.w, t.budget,
             CAST(sum(size) OVER (PARTITION BY d.sk ORDER BY key) AS BIGINT) AS cum FROM d JOIN t ON d.sk = t.sk),
e AS (SELECT p.*, epoch, (epoch * source_size + cum) / w AS finish FROM p, (SELECT unnest([0, 1]) AS epoch)),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, sk, epoch, key) AS total FROM e)
SELECT doc_id, size, source_size, target,
       CAST(sum(CASE WHEN total <= budget THEN size ELSE 0 END) AS BIGINT) AS taken
FROM c GROUP BY doc_id, sk, key, size, source_size, target
"""


@query
def op11_sharding(spark, sf_dir):
    """All documents in 24 contiguous shards of equal bytes."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return assign_shards(docs, shards=24, carry=["doc_id"]).select(
        "row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# crc is CRC-32 by the table of its polynomial; equal rows of the order agree in all columns
ORACLE["op11_sharding"] = r"""
WITH RECURSIVE bit AS (
  SELECT range AS i, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bit WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bit WHERE k = 8),
d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size,
        list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
e AS (SELECT doc_id, size, xor(4294967295, list_reduce([4294967295] || bytes,
        lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)]))) AS text_crc32 FROM d, crc),
p AS (SELECT *, CAST(sum(size) OVER o AS BIGINT) AS upto, CAST(sum(size) OVER () AS BIGINT) AS total, row_number() OVER o AS k FROM e
      WINDOW o AS (ORDER BY doc_id NULLS LAST, size, text_crc32 ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CAST((2 * upto - size) * 24 // (2 * total) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  CAST(k - min(k) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""


@query
def op12_collocations(spark, sf_dir):
    """Each language's 2,000 strongest phrases of two to five words that occur a hundred times or more."""
    return collocations(documents(spark, sf_dir).select("text", "lang"), min_count=100, longest=5, top=2000)


@query
def op13_conversation_repair(spark, sf_dir):
    """Every conversation, damaged by checksums and repaired by the cheapest edits."""
    rows = read_table(spark, sf_dir, "conversations")
    return repaired_or_empty(rows, damaged(rows)).withColumnRenamed("digest", "repaired_sha256")
