"""Queries of the operators for training data and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions.text import WORD_BREAK
from siftstone.functions.windows import FACTOR, MIX_1, MIX_2
from siftstone.llm.grouping import components, record_number
from siftstone.llm.layout import copies_by_layout, equal_contents
from siftstone.llm.mixing import clean_source, mix
from siftstone.llm.near import similar_groups, similar_pairs
from siftstone.llm.packing import audit, fills, pack
from siftstone.llm.repetition import BINS, SMOOTHING, WINDOW, likelihood_ratios, repetition, repetitive
from siftstone.llm.lexicon import fit_lexicon
from siftstone.llm.sentences import coverage, sentence_units
from siftstone.llm.tokens import token_counts


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark, d):
    return repetitive(table(spark, d, "documents"))


def p1_share(spark, d):
    return repetition(table(spark, d, "documents"))


def p1_llr(spark, d):
    """Score of every text that has n-grams, and whether it reaches the threshold."""
    found = likelihood_ratios(table(spark, d, "documents")).where("n_windows > 0")
    return found.select("doc_id", "n_windows", F.round("llr", 6).alias("llr"), "flagged")


def p2_found(spark, d):
    edges = table(spark, d, "edges").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    forest = table(spark, d, "components").select(record_number("node").alias("a"), record_number("parent").alias("b"))
    return components(edges.unionByName(forest))


def p3_found(spark, d):
    return similar_pairs(table(spark, d, "documents"))


def p3_groups(spark, d):
    return similar_groups(table(spark, d, "documents"))


def p4_found(spark, d):
    return copies_by_layout(table(spark, d, "documents"))


def p4_contents(spark, d):
    """One row per content: its first document and how many copies it has."""
    return equal_contents(table(spark, d, "documents"))[0].select("first_doc", "copies")


def p6_containers(spark, d):
    """The container of each text, or of each piece of a text above the capacity."""
    return pack(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p6_fill(spark, d):
    """How full each container is."""
    sizes = table(spark, d, "pack_sizes")
    return fills(pack(table(spark, d, "documents"), sizes), sizes)


def p6_audit(spark, d):
    """Documents placed, containers above their capacity, documents placed wrongly."""
    docs, sizes = table(spark, d, "documents"), table(spark, d, "pack_sizes")
    return audit(pack(docs, sizes), sizes, token_counts(docs))


def p7_drawn(spark, d):
    """The chosen documents with their uses."""
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark, d):
    """Wanted and reached shares of each source."""
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_audit(spark, d):
    """Of each source: whether no text is used above its repeats or named twice, whether the fitted rates meet the target share, and whether the tokens drawn miss their budget by no more than half a text."""
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    drawn, shares = mix(docs, targets)
    longest = token_counts(docs).join(docs.select("doc_id", clean_source(F.col("source")).alias("source")), "doc_id").groupBy("source").agg(F.max("n_tokens").alias("longest"))
    caps = targets.select(clean_source(F.col("source")).alias("source"), "max_repeats")
    used = drawn.groupBy("source").agg(F.min("uses").alias("least"), F.max("uses").alias("most"), F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("ids"))
    present = shares.where("budget_tokens > 0").agg(F.sum("target_share").alias("n")).scalar()  # a source without texts leaves its share to the others
    each = shares.join(used, "source").join(caps, "source").join(longest, "source")
    return each.select(
        "source", ((F.col("least") >= 1) & (F.col("most") <= F.col("max_repeats"))).alias("within_repeats"), (F.col("n") == F.col("ids")).alias("named_once"),
        (F.abs(F.col("expected_share") - F.col("target_share") / present) < 1e-4).alias("fitted"), (F.abs(F.col("tokens") - F.col("budget_tokens")) <= F.col("longest") / 2 + 1).alias("drawn_to_budget"),
    )


def p8_found(spark, d):
    """Sentences of the documents in sent_docs; words are counted in all documents. The semi-join needs no hint: Spark broadcasts the ids only below its size limit."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    wanted = table(spark, d, "sent_docs").select("doc_id")
    return sentence_units(docs.join(wanted, "doc_id", "left_semi"), lexicon=fit_lexicon(docs))


def p8_counts(spark, d):
    """Sentences and their mean length in each document of the whole table."""
    docs = table(spark, d, "documents")
    units = sentence_units(docs, lexicon=fit_lexicon(docs))
    return units.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.avg(F.col("end_char") - F.col("start_char")).alias("mean_chars"))


def p8_cover(spark, d):
    """Audit of the sentences of the whole table: all characters but blanks are covered once, no edge is a blank."""
    docs = table(spark, d, "documents")
    return coverage(sentence_units(docs, lexicon=fit_lexicon(docs)), docs)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_share, p1_llr, p2_found, p3_found, p3_groups, p4_found, p4_contents, p6_containers, p6_fill, p6_audit, p7_drawn, p7_shares, p7_audit, p8_found, p8_counts, p8_cover)}


# ---- SQL


def _ratio_sql(letters: str) -> str:
    """p1_llr from the texts: the window hash and its finaliser in 128-bit arithmetic, classes, both multinomials, scores."""
    whole, classes = 1 << 64, BINS + 1
    powers = [pow(int(FACTOR), WINDOW - k, whole) for k in range(WINDOW)]
    window = " + ".join(f"{'v' if not k else f'lead(v, {k}) OVER w'} * {p}::UHUGEINT" for k, p in enumerate(powers))
    return f"""WITH t AS (SELECT doc_id, {letters} AS cs FROM documents WHERE text IS NOT NULL),
      u AS (SELECT doc_id, (unicode(unnest(cs)) + 1)::UHUGEINT AS v, generate_subscripts(cs, 1) AS i FROM t),
      h AS (SELECT doc_id, i, (({window}) % {whole}::UHUGEINT)::UBIGINT AS x FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
      m1 AS (SELECT doc_id, i, ((xor(x, x >> 30)::UHUGEINT * {int(MIX_1)}::UHUGEINT) % {whole}::UHUGEINT)::UBIGINT AS x FROM h WHERE x IS NOT NULL),
      m2 AS (SELECT doc_id, i, ((xor(x, x >> 27)::UHUGEINT * {int(MIX_2)}::UHUGEINT) % {whole}::UHUGEINT)::UBIGINT AS x FROM m1),
      e AS MATERIALIZED (SELECT doc_id, xor(x, x >> 31) % {BINS} AS bin, row_number() OVER (PARTITION BY doc_id, x ORDER BY i) > 1 AS again FROM m2),
      d AS MATERIALIZED (SELECT doc_id, count(*) AS n_windows, count(*) FILTER (again) AS n_again FROM e GROUP BY doc_id),
      s AS (SELECT sum(n_windows) AS raw, sum(n_again) AS again, sum(n_windows) FILTER (n_again = 0) AS target FROM d),
      c AS (SELECT ln((raw - again + {SMOOTHING}) / (raw + {SMOOTHING * classes})) - ln((target + {SMOOTHING}) / (target + {SMOOTHING * classes})) AS common, raw, target FROM s),
      r AS (SELECT bin, ln((count(*) + {SMOOTHING}) / (any_value(raw) + {SMOOTHING * classes})) - ln({SMOOTHING} / (any_value(target) + {SMOOTHING * classes})) AS ratio FROM e, c WHERE again GROUP BY bin),
      l AS (SELECT doc_id, sum(ratio - common) AS more FROM e JOIN r USING (bin), c WHERE again GROUP BY doc_id),
      low AS (SELECT min(ratio) AS low FROM r),
      z AS (SELECT doc_id, n_windows, common + coalesce(more, 0) / n_windows AS llr, common + 0.3::DOUBLE / {WINDOW} * (low - common) - 1e-9 AS threshold FROM d LEFT JOIN l USING (doc_id), c, low)
      SELECT doc_id, n_windows, round(llr, 6) AS llr, llr >= threshold AS flagged FROM z"""


def oracle() -> dict[str, str]:
    letters = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]')"
    window = " || ".join(["c", *(f"lead(c, {k}) OVER w" for k in range(1, 30))])
    share = f"""WITH t AS (SELECT doc_id, {letters} AS cs FROM documents WHERE text IS NOT NULL),
      u AS (SELECT doc_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM t),
      r AS (SELECT doc_id, i, hash({window}) AS h FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
      s AS (SELECT doc_id, i, CASE WHEN h IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, h ORDER BY i) > 1 THEN 1 ELSE 0 END AS again,
              (SELECT 1) FROM r),
      m AS (SELECT doc_id, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS 29 PRECEDING) AS again FROM s),
      n AS (SELECT doc_id, count(*) AS n_units, sum(again)::BIGINT AS n_repeated FROM m GROUP BY doc_id)"""
    share = share.replace(f"hash({window})", window).replace(",\n              (SELECT 1) FROM r", " FROM r")
    grams = "c || lead(c, 1) OVER w || lead(c, 2) OVER w || lead(c, 3) OVER w || lead(c, 4) OVER w"
    similar = f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '(?s).') AS cs FROM documents WHERE length(text) >= 40),
      u AS (SELECT doc_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM t),
      g AS MATERIALIZED (SELECT DISTINCT doc_id, hash(g) AS g FROM (SELECT doc_id, {grams} AS g FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE g IS NOT NULL),
      n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
      both_in AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
      pair AS MATERIALIZED (SELECT a AS doc_a, b AS doc_b FROM both_in JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE k >= 0.7 * (p.n + q.n - k))"""
    groups = similar.replace("WITH t", "WITH RECURSIVE t") + """, e AS MATERIALIZED (SELECT doc_a AS a, doc_b AS b FROM pair UNION ALL SELECT doc_b, doc_a FROM pair),
      cc(node, root) USING KEY (node) AS (
        SELECT DISTINCT a, a FROM e
        UNION
        (SELECT e.a, min(u.root) FROM cc u JOIN e ON e.b = u.node JOIN recurring.cc c ON c.node = e.a WHERE u.root < c.root GROUP BY e.a)),
      deg AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
      SELECT n.doc_id, coalesce(root, n.doc_id) AS group_id, coalesce(n_links, 0) AS n_links FROM n LEFT JOIN cc ON node = n.doc_id LEFT JOIN deg ON deg.a = n.doc_id"""
    alnum = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]', '', 'g')".format
    contents = f"""WITH d AS MATERIALIZED (SELECT doc_id, text, {alnum("text")} AS letters FROM documents WHERE length(text) >= 40),
      pieces AS (
        SELECT doc_id, 0 AS kind, unnest(regexp_extract_all(text, '"[^"]+": "(?:[^"\\\\]|\\\\.)*"')) AS piece FROM d WHERE regexp_matches(text, '^[^\\p{{L}}\\p{{N}}]*[{{](?s:.*)[}}][^\\p{{L}}\\p{{N}}]*$')
        UNION ALL SELECT doc_id, 1, unnest(regexp_split_to_array(text, '[\\r\\n]+')) FROM d
        UNION ALL SELECT doc_id, 2, unnest(string_split(text, '|')) FROM d
        UNION ALL SELECT doc_id, 3, unnest(string_split(text, ';')) FROM d),
      named AS (SELECT doc_id, kind, piece, regexp_extract(piece, '^([\\s>*•–—#"''_{{-]*)([\\p{{L}}][^:：\\n|;"]*?)([\\s*"''_]*[:：])', ['lead', 'name', 'colon']) AS m
        FROM pieces WHERE {alnum("piece")} <> ''),
      split AS (SELECT doc_id, kind, m.name AS name, substr(piece, length(m.lead || m.name || m.colon) + 1) AS value FROM named),
      card AS (SELECT doc_id, kind, list_sort(list({alnum("name")} || chr(1) || {alnum("value")})) AS fields FROM split
        GROUP BY 1, 2 HAVING count(*) > 1 AND bool_and(name <> '')),
      keyed AS (SELECT d.doc_id, letters, arg_min(fields, kind) AS fields FROM d LEFT JOIN card USING (doc_id) GROUP BY 1, 2),
      content AS (SELECT doc_id, coalesce(array_to_string(min(fields) OVER (PARTITION BY letters), chr(2)), letters) AS content FROM keyed),
      first AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY content) AS first_doc FROM content)"""
    links = """SELECT src AS a, dst AS b FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL
      UNION SELECT try_cast(trim(node) AS BIGINT), try_cast(trim(parent) AS BIGINT) FROM components
      WHERE try_cast(trim(node) AS BIGINT) IS NOT NULL AND try_cast(trim(parent) AS BIGINT) IS NOT NULL"""
    return {
        "p1_found": f"{share} SELECT doc_id FROM n WHERE n_repeated >= 0.30 * n_units AND n_units > 0",
        "p1_share": f"""{share} SELECT d.doc_id, CASE WHEN text IS NOT NULL THEN coalesce(n_units, 0) END AS n_units, CASE WHEN text IS NOT NULL THEN coalesce(n_repeated, 0) END AS n_repeated,
          CASE WHEN text IS NOT NULL THEN coalesce(n_repeated / n_units, 0.0) END::DOUBLE AS repeated_share FROM documents d LEFT JOIN n USING (doc_id)""",
        "p1_llr": _ratio_sql(letters),
        "p6_audit": "SELECT pack_name, (SELECT count(*) FROM documents WHERE text <> '') AS n_docs, 0::BIGINT AS n_over, 0::BIGINT AS n_wrong FROM pack_sizes",
        "p7_audit": "SELECT lower(trim(source)) AS source, TRUE AS within_repeats, TRUE AS named_once, TRUE AS fitted, TRUE AS drawn_to_budget FROM mix_targets WHERE lower(trim(source)) IN (SELECT lower(trim(source)) FROM documents WHERE text <> '')",
        "p8_cover": f"""SELECT doc_id, length(regexp_replace(text, '{WORD_BREAK}', '', 'g')) AS covered, 0::BIGINT AS overlaps, 0 AS blank_edges
          FROM documents WHERE regexp_replace(text, '{WORD_BREAK}', '', 'g') <> ''""",
        "p3_found": f"{similar} SELECT doc_a, doc_b FROM pair",
        "p3_groups": groups,
        "p4_found": f"{contents} SELECT first_doc, doc_id FROM first WHERE first_doc < doc_id",
        "p4_contents": f"{contents} SELECT first_doc, count(*) AS copies FROM first GROUP BY 1",
        "p2_found": f"""WITH RECURSIVE link AS MATERIALIZED ({links}),
          e AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link),
          cc(node, component) USING KEY (node) AS (
            SELECT DISTINCT a, a FROM e
            UNION
            (SELECT e.a, min(u.component) FROM cc u JOIN e ON e.b = u.node JOIN recurring.cc c ON c.node = e.a WHERE u.component < c.component GROUP BY e.a))
          SELECT component, node FROM cc""",
    }
