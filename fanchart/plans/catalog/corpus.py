"""Corpus and text queries. Every audit reads whole texts; only prompts are cut."""

from __future__ import annotations

from pyspark.sql import functions as F

from fanchart.operators import corpus as X
from fanchart.plans.catalog.common import text
from fanchart.plans.registry import query

_KEPT = {
    "kept": "SELECT i.unit_id, i.pos, i.doc_id, i.timestamp, i.doc_type, f.text FROM doc_index i JOIN doc_units u ON u.unit_id = i.unit_id "
            "JOIN docs f ON f.unit_id = i.unit_id AND f.path = regexp_replace(i.path, '^[./]+', '') WHERE i.timestamp <= CAST(u.asof AS VARCHAR)",
    "ranked_docs": "SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY timestamp DESC, pos) AS rank FROM kept",
}


def _index(t):
    return t.index.withColumn("path", F.regexp_replace("path", r"^[./]+", ""))


def _kept(t):
    return X.docs_asof(_index(t), t.docs, t.doc_units)


@query("txt1_docs_asof", "SELECT i.unit_id, coalesce(k.n, 0) AS kept, i.n - coalesce(k.n, 0) AS excluded FROM (SELECT unit_id, count(*) AS n FROM doc_index GROUP BY 1) i LEFT JOIN (SELECT unit_id, count(*) AS n FROM kept GROUP BY 1) k ON k.unit_id = i.unit_id", _KEPT)
def docs_asof(t):
    return _kept(t)[1]


@query("txt2_newest_k", "SELECT unit_id, doc_id, timestamp, CAST(rank AS INTEGER) AS rank FROM ranked_docs WHERE rank <= 8", _KEPT)
def newest_k(t):
    return X.newest_k(_kept(t)[0])[0].select("unit_id", "doc_id", "timestamp", "rank")


@query("txt2_dropped", "SELECT unit_id, greatest(0, count(*) - 8) AS dropped FROM kept GROUP BY 1", _KEPT)
def dropped(t):
    return X.newest_k(_kept(t)[0])[1]


@query("txt3_truncate_doc", "SELECT doc_id, length(substr(text, 1, 6000)) AS kept_chars, md5(substr(text, 1, 6000)) AS digest FROM documents")
def truncate(t):
    cut = X.truncate_doc("text")
    return t.read("documents").select("doc_id", F.length(cut).cast("long").alias("kept_chars"), F.md5(cut).alias("digest"))


LANGUAGES = ("de", "en", "es", "fr")
_CONTEXT = {
    **_KEPT,
    "lang_stats": "SELECT source AS unit_id, lang AS asset, avg(n_chars) AS last, coalesce(stddev_samp(n_chars), CAST(0 AS DOUBLE)) AS sd_h FROM documents WHERE lang IN ('de', 'en', 'es', 'fr') GROUP BY 1, 2",
    "asset_lines": "SELECT unit_id, string_agg(printf('  %s: level %.6f, horizon sd %.6f', asset, last, sd_h), chr(10) ORDER BY asset) AS a FROM lang_stats GROUP BY 1",
    "doc_lines": "SELECT unit_id, count(*) AS n, string_agg('--- ' || doc_id || ' (' || timestamp || ', ' || doc_type || ') ---' || chr(10) || substr(text, 1, 6000), chr(10) ORDER BY rank) AS d FROM ranked_docs WHERE rank <= 8 GROUP BY 1",
}


@query("txt4_context_pack", "SELECT u.unit_id, length(c) AS chars, md5(c) AS digest FROM (SELECT u.unit_id, concat_ws(chr(10), 'As-of date: 2000-02-09', 'Target type: level. Horizons: 5, 21', a.a, 'Documents: ' || coalesce(d.n, 0), d.d, 'Give two numbers for each asset.') AS c FROM doc_units u "
       "LEFT JOIN asset_lines a ON a.unit_id = u.unit_id LEFT JOIN doc_lines d ON d.unit_id = u.unit_id) u", _CONTEXT)
def context_pack(t):
    units = t.doc_units.select(
        "unit_id", "asof", F.lit("level").alias("target_type"), F.array(*[F.lit(x) for x in LANGUAGES]).alias("asset_ids"), F.array(F.lit(5), F.lit(21)).alias("horizons")
    )
    stats = t.read("documents").where(F.col("lang").isin(*LANGUAGES)).groupBy(F.col("source").alias("unit_id"), F.col("lang").alias("asset")).agg(
        F.avg("n_chars").alias("last"), F.coalesce(F.stddev_samp("n_chars"), F.lit(0.0)).alias("sd_h")
    )
    packed = X.context_pack(X.newest_k(_kept(t)[0])[0], stats, units, "Give two numbers for each asset.")
    return packed.select("unit_id", F.length("context").cast("long").alias("chars"), F.md5("context").alias("digest"))


@query("txt5_doc_header", "SELECT doc_id, source AS h_source, CAST(CAST(DATE '1996-01-01' + CAST(doc_id % 2000 AS INTEGER) AS DATE) AS VARCHAR) AS h_date, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS h_type FROM documents")
def doc_header(t):
    date = F.date_add(F.to_date(F.lit("1996-01-01")), (F.col("doc_id") % 2000).cast("int")).cast("string")
    kind = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(" | type: "), "lang"))
    head = F.concat(F.lit("# source: "), "source", F.lit(" | date: "), date, kind, F.lit("\n"), "text")
    return t.read("documents").select("doc_id", head.alias("text")).select("doc_id", *X.doc_header("text"))


_SENTENCES = "SELECT {key}, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS sentence FROM (SELECT {key}, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10))) AS s FROM {table})"


@query(
    "txt6_passage_overlap",
    "SELECT d.doc_id, count(*) AS sentences, count_if(r.sentence IS NOT NULL) AS verbatim FROM doc_sentences d LEFT JOIN (SELECT DISTINCT sentence FROM ref_sentences) r ON r.sentence = d.sentence WHERE d.sentence <> '' GROUP BY 1",
    {"doc_sentences": _SENTENCES.format(key="doc_id", table="documents"), "ref_sentences": _SENTENCES.format(key="item_id", table="benchmark")},
)
def passage_overlap(t):
    return X.passage_overlap(t.read("documents"), t.read("benchmark").select(F.col("item_id").alias("ref_id"), "text"))


_WORDS = "SELECT {key}, unnest(regexp_extract_all(text, '[^\\s]+')) AS w, unnest(range(len(regexp_extract_all(text, '[^\\s]+')))) AS i FROM {table}"


@query(
    "txt6_longest_shared_run",
    "SELECT d.doc_id, CAST(coalesce(max(run), 0) AS INTEGER) AS longest_run FROM documents d LEFT JOIN (SELECT doc_id, item_id, k, island, count(*) AS run FROM (SELECT a.doc_id, b.item_id, a.i - b.i AS k, "
    "a.i - row_number() OVER (PARTITION BY a.doc_id, b.item_id, a.i - b.i ORDER BY a.i) AS island FROM doc_words a JOIN ref_words b ON a.w = b.w) GROUP BY ALL) r ON r.doc_id = d.doc_id GROUP BY 1",
    {"doc_words": _WORDS.format(key="doc_id", table="documents"), "ref_words": _WORDS.format(key="item_id", table="benchmark")},
)
def longest_run(t):
    return X.longest_shared_run(t.read("documents"), t.read("benchmark"))


PATTERNS = {"license": r"(?i)licen[sc]e", "mail": r"[a-zA-Z0-9_.]+@[a-zA-Z0-9_.]+", "digits": r"[0-9]{4,}"}
CONTROL = "planted control phrase"


@query("txt7_phrase_search", " UNION ALL ".join(
    f"SELECT '{name}' AS pattern, count_if(len(regexp_extract_all(text, '{p}')) > 0) AS documents, CAST(sum(len(regexp_extract_all(text, '{p}'))) AS BIGINT) AS hits FROM documents" for name, p in PATTERNS.items()
) + f" UNION ALL SELECT 'control', count_if(contains(text, '{CONTROL}')) + 1, count_if(contains(text, '{CONTROL}')) + 1 FROM documents")
def phrase_search(t):
    return X.phrase_search(t.read("documents"), PATTERNS, CONTROL)


@query("txt8_positioning_table", "SELECT l_orderkey AS doc_id, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS report_date, l_partkey AS open_interest, l_suppkey AS noncomm_long, CAST(l_linenumber AS BIGINT) AS noncomm_short, -CAST(l_quantity AS BIGINT) AS noncomm_net FROM lineitem")
def positioning_table(t):
    row = F.format_string(
        " %s %14d %14d %14d %14d", F.col("l_shipdate").cast("date").cast("string"), F.col("l_partkey"), F.col("l_suppkey"),
        F.col("l_linenumber").cast("long"), -F.col("l_quantity").cast("long"),
    )
    # a report holds the few lines of one order
    docs = t.read("lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.concat(F.lit("Weekly positions\n\nreport_date  open_interest  long  short  net\n"), F.array_join(F.collect_list(row), "\n")).alias("text")
    )
    return X.positioning_table(docs).select("doc_id", text("report_date"), "open_interest", "noncomm_long", "noncomm_short", "noncomm_net")


