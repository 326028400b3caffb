"""The registered queries of the training-data operators: thin digests over their outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, bpe, chat, decontaminate, html, lexical, lm, pii, secrets, simhash, toxicity, warc
from .common import crc_bucket, table

#: A document is called toxic from this score on.
TOXIC_FROM = 0.3


def tokenizer() -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return bpe.read_ranks(None, public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op1_lm_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), crc_bucket(F.col("doc_id"), 7) == 2)


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    rows = F.array(*(F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text")) for k, role in enumerate(("user", "assistant"))))
    extra = spark.range(1).select(F.inline(rows))
    made = chat.windows(turns.unionByName(extra))
    new = F.slice(chat.read_turns(F.col("formatted")), F.col("n_repeated").cast("int") + 1, F.col("n_turns").cast("int"))
    read = made.select("conv_id", "window", "formatted", new.alias("new"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("new", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.select("conv_id", "window", F.size("new").cast("long").alias("n"), lines.alias("lines"), "loss", F.char_length("formatted").cast("long").alias("chars"))
    whole = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "lines", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return whole.select("conv_id", "n_turns", F.sha2(F.array_join(F.transform("w", lambda x: x["lines"]), ""), 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def op3_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = tokenizer()
    return bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern, with_ids=False)


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), key="vigilog")


def op6_secret_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != "grammar")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", name), ",").alias("spans"))


def op7_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read(warc.write(table(spark, sf_dir, "pages")), with_payload=False).filter("not gap")
    return found.select(warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), warc.page_of("refers_to").alias("refers_to"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_lm_filter, op2_chat_windows, op3_page_text, op4_byte_bpe, op5_pii_surrogates, op6_secret_grammar, op7_posting_lists, op8_simhash, op9_decontaminate, op10_toxicity, op11_filter_audit, op12_warc_salvage, op13_lexical_search)}

_AUDIT = r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS smallest FROM docs),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, coalesce(good, 0) AS good, coalesce(known.toxic, 0) AS toxic,
    CASE WHEN len(words) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > smallest THEN 16 ELSE 0 END AS mask FROM split LEFT JOIN known USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before FROM orders, range(1, 6) AS r(step)),
made AS (SELECT part, filter_order, step, bit,
    CAST(sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
    FROM cells, steps GROUP BY part, filter_order, step, bit, before)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM made
"""

_ARCHIVED = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
f AS (SELECT page_id, strlen(t) AS payload_bytes, sha256(t) AS payload_digest, CASE WHEN strlen(t) >= 100 THEN min(page_id) OVER (PARTITION BY t) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN coalesce(page_id, -1) <> coalesce(first, page_id, -1) THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN coalesce(page_id, -1) <> coalesce(first, page_id, -1) THEN first END AS refers_to FROM f
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_RANKED = f"""
WITH d AS (SELECT row_number() OVER () AS nr, doc_id, {_TERMS} AS ts FROM documents),
totals AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
lengths AS (SELECT nr, doc_id, 25 + (75 * CAST(len(ts) AS BIGINT) * n_docs) // n_terms AS m FROM d, totals WHERE len(ts) > 0),
postings AS (SELECT nr, term, count(*) AS tf FROM (SELECT nr, unnest(ts) AS term FROM d) GROUP BY nr, term),
asked AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS item, item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item, item_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM postings, totals GROUP BY term),
scored AS (SELECT item, item_id, nr, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (nr) GROUP BY item, item_id, nr, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

#: The other operators learn models, hash or parse in ways that SQL can't express; their tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op11_filter_audit": _AUDIT, "op12_warc_salvage": _ARCHIVED, "op13_lexical_search": _RANKED}
