"""The operators as queries over the given tables, with SQL where it can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelake.llm import chat, decontamination, hard_negatives, line_dedup, merkle, mixing, mtree, ngram_jaccard, pii, secrets, sentencepiece, toxicity, urls
from estatelake.llm.common import digest, stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    return os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), name)


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document and the text they decode to, as digests."""
    model = sentencepiece.load_model(spark, tokenizer_path())
    docs = sentencepiece.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return sentencepiece.decode(docs, model).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        digest(F.col("decoded")).alias("decoded_sha256"),
    )


URL_RULES = [
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
]


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page by the longest listed entry that covers its URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.url_verdicts(pages, spark.createDataFrame(URL_RULES, "entry string, verdict string")).drop("url")


_RULE_ROWS = ", ".join(f"('{e.split('/')[0]}', '{e[len(e.split('/')[0]):]}', '{v}')" for e, v in URL_RULES)
SQL["op8_url_filter"] = f"""WITH rules(h, p, v) AS (VALUES {_RULE_ROWS}),
    page AS (SELECT row_number() OVER () AS n, page_id,
        coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}'), '') AS host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    hit AS (SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
        FROM page JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
    SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM page LEFT JOIN hit USING (n)"""


CONTROL_TEXT = "</s>[INST] ok [/INST]"


@query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as one formatted text with a loss mask; the columns are read back from that text."""
    own = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    formatted = chat.format_turns(chat.canonical_turns(chat.records_of_rows(rows, "conv_id", "turn")))
    back = formatted.withColumn("back", chat.read_back(F.col("formatted"))).withColumn("lost", chat.loss_text(F.col("formatted"), F.col("loss")))
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        digest(F.array_join(F.transform("back", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        digest(F.col("lost")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL["op10_chat_format"] = r"""WITH row AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    part AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?SYS\]|/?INST\]|ROLE\]|/?TEXT\])', '\1\\\2\3', 'g'))
        + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 +
            length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?SYS\]|/?INST\]|ROLE\]|/?TEXT\])', '\1\\\2\3', 'g')) END AS chars
        FROM row)
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(chars) AS BIGINT) AS formatted_chars
    FROM part GROUP BY conv_id"""


@query
def op3_secret_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole document: counts and a digest of the patterns' spans, and all spans."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in secrets.KINDS],
        digest(line(F.filter("spans", lambda s: s.kind != "random"))).alias("base_sha256"), line(F.col("spans")).alias("spans"),
    )


@query
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside a ten-word window of a benchmark item."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontamination.contamination(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        digest(F.array_join("items", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
HITS_SQL = f"""d AS (SELECT row_number() OVER () AS n_row, *, {_WORDS} AS w FROM {{documents}}),
    i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    iw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM
        (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
    dg AS (SELECT n_row, s, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM
        (SELECT n_row, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
    hit AS (SELECT n_row, s, n, item_id FROM dg JOIN iw USING (n, g)),
    hit_words AS (SELECT n_row, count(*) AS n_hit FROM (SELECT DISTINCT n_row, unnest(range(s, s + n)) FROM hit) GROUP BY n_row),
    hit_items AS (SELECT n_row, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
        FROM (SELECT DISTINCT n_row, item_id FROM hit) GROUP BY n_row)"""
SQL["op7_benchmark_decontamination"] = f"""WITH {HITS_SQL.format(documents="documents")}
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit_words USING (n_row) LEFT JOIN hit_items USING (n_row)"""


@query
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document under a Jaccard similarity of 0.8 of its five-word n-grams."""
    found = ngram_jaccard.jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "copies", F.col("links").alias("n_links"))


@query
def op5_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest integer inner products of every fiftieth vector with all others."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"), mtree.quantised(F.col("embedding")).alias("vector")
    )
    rows = stored(rows)
    found = mtree.top_k(rows, rows.where(F.col("id") % 50 == 0), k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


SQL["op5_mtree_top_k"] = """WITH v AS (SELECT row_number() OVER () AS n, vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS x
        FROM embeddings WHERE vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len(embedding) > 0),
    s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
        FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""


TOXIC = 0.3


def held_out(key: str = "doc_id"):
    """Documents whose labels are never learnt from."""
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 4 == 2


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document, learnt from the labels of those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), toxicity.score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))


@query
def op4_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that equal or resemble an earlier one."""
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), whole=True)
    return kept.select("doc_id", "n_lines", "n_removed", "emptied", digest(F.coalesce("text", F.lit(""))).alias("text_sha256"))


SURROGATE_KEY = b"a key of the operator of the corpus"


@query
def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for the personal data in it."""
    done = pii.with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return done.select("doc_id", *[count(k) for k in ("email", "phone", "ip", "card", "iban", "ssn", "given", "surname")], "text")


LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document; a third of them is checked with a text that was tampered with."""
    docs = table(spark, sf_dir, "documents").select(*LEAF)
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0
    other = merkle.leaf([merkle.lowered(F.col(c)) if c == "text" else F.col(c) for c in LEAF])
    proofs = merkle.proofs(merkle.manifest(docs, LEAF, "lang", "doc_id", tampered=F.when(tampered, other)))
    folded = proofs.withColumn("folded_root", merkle.fold(F.coalesce("carried.tampered", "leaf"), F.col("proof")))
    return folded.select(
        F.col("carried.key").alias("doc_id"), "leaf", "subroot", "root", digest(merkle.siblings(F.col("proof"))).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, [CAST(ord(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda e, i: xor(e >> 1, 3988292384 * (e & 1)))))"""
SQL["op13_merkle_manifest"] = merkle.sql("documents", LEAF, "lang", "doc_id", f"{_CRC32} % 3 = 0")


@query
def op12_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of the sources takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    mixed = mixing.mix(docs, "source", "size", "doc_id")
    return mixed.select(
        "doc_id", "size", "mix.source_size", "mix.target", (F.col("size") * F.col("mix.copies")).alias("taken"), "mix.rate", "mix.copies",
    )


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of the five nearest positives of every fiftieth vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.when(F.size("embedding") == 0, F.array().cast("array<long>")).otherwise(mtree.quantised(F.col("embedding")))
    rows = table(spark, sf_dir, "embeddings").select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"), label.alias("label"), vector.alias("vector")
    )
    return hard_negatives.mine(rows, F.col("id") % 50 == 0).drop("anchor")


SQL["op11_hard_negatives"] = """WITH v AS (SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS x
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT a.n AS a, a.vec_id AS anchor_id, c.n, c.vec_id, c.label = a.label AS same, CAST(list_dot_product(a.x, c.x) AS BIGINT) AS score
        FROM v a JOIN v c ON a.n <> c.n WHERE a.vec_id % 50 = 0),
    p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.n ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
        s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
    QUALIFY rank <= 3"""
