"""Registry of the engine's queries on the driver tables, with DuckDB equivalents."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import Settings
from .functions import geometry as G
from .functions import text as X
from .operators import assemble, blocks, catalog, correction, export, language, layout, metrics, quality, routing, search, spatial, spell, tables
from .plans import lineblocks as L
from .scratch import kept, shared_dir
from .session import prepare
from .sources import files, seams
from .streaming import state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: White space, control and digit classes as DuckDB's patterns write them (its engine knows the same escapes).
W = X.SPACES
LETTER_RANGE = r"\x{41}-\x{5A}\x{61}-\x{7A}"
LINES = f"WITH lines AS ({L.LINES_SQL}), "
TYPED = (
    LINES
    + rf"""b AS (SELECT *, CASE WHEN len(regexp_extract_all(text, '[^{W}\x{{0B}}\x{{0C}}\x{{1C}}-\x{{1F}}\x{{85}}]+')) <= 8 AND y1 - y0 >= 30
  THEN 'heading' ELSE 'paragraph' END AS type FROM lines)"""
)


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        @functools.wraps(f)
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = prepared
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.line_blocks(_t(spark, sf_dir, "documents"))


def _edges(*names: str) -> list:
    return [F.col(f"bbox.{n}").alias(n) for n in (names or ("x0", "y0", "x1", "y1"))]


# --- text -----------------------------------------------------------------------------------------------------


@query(
    rf"""SELECT doc_id, length(c) AS n, md5(c) AS digest FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(
    nfc_normalize(text), '[\x{{FFFD}}{X.CONTROLS}]', '', 'g'), '[{W}]+', ' ', 'g')) AS c FROM documents)"""
)
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.clean_text(F.col("text"))
    rows = _t(spark, sf_dir, "documents").select("doc_id", c.alias("c"))
    return rows.select("doc_id", F.length("c").cast("long").alias("n"), F.md5("c").alias("digest"))


_FAMILIES = ", ".join(
    rf"length(regexp_replace(l, '[^\x{{{a:X}}}-\x{{{b:X}}}]', '', 'g')) AS {n}" for n, a, b in X.SCRIPTS
)
_OTHERS = " OR ".join(f"{n} >= 0.1 * letters" for n, *_ in X.SCRIPTS if n not in X.PRIMARY_SCRIPTS)
_COUNT = " + ".join(f"CASE WHEN {n} >= 0.1 * letters THEN 1 ELSE 0 END" for n, *_ in X.SCRIPTS)


@query(
    rf"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\p{{L}}]', '', 'g') AS l FROM documents),
    c AS (SELECT doc_id, length(l) AS letters, {_FAMILIES} FROM t)
    SELECT doc_id, letters, latin, greek, cyrillic, letters > 0 AND ({_COUNT}) >= 2 AND ({_OTHERS}) AS mixed_script FROM c"""
)
def script_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = routing.script_mix(_t(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "letters", "latin", "greek", "cyrillic", "mixed_script")


_SCRIPT = ("telugu", "tamil", "latin", "kannada", "gujarati", "devanagari", "bengali")  # equal counts: the last name of the alphabet
_RANGE = {n: rf"\x{{{a:X}}}-\x{{{b:X}}}" for n, a, b in X.SCRIPTS}
_COUNTS = ", ".join(rf"length(regexp_replace(l, '[^{_RANGE[n]}]', '', 'g')) AS {n}" for n in _SCRIPT)
_OWN = rf"[{W}\x{{0B}}\x{{0C}}\x{{1C}}-\x{{1F}}\x{{85}}]+"


@query(
    LINES
    + rf"""s AS (SELECT doc_id, seq, text, regexp_replace(regexp_replace(text, '^{_OWN}', ''), '{_OWN}$', '') AS t, regexp_replace(text, '[^\p{{L}}]', '', 'g') AS l FROM lines),
    c AS (SELECT *, {_COUNTS} FROM s),
    g AS (SELECT *, greatest({", ".join(_SCRIPT)}) AS most FROM c),
    k AS (SELECT *, CASE {" ".join(f"WHEN {n} = most THEN '{n}'" for n in _SCRIPT)} END AS script FROM g)
    SELECT doc_id AS document_id, seq, CASE WHEN length(t) < 4 OR most = 0 THEN 'und'
      WHEN script = 'devanagari' THEN CASE WHEN regexp_matches(text, '{language.MARATHI}') THEN 'mr' ELSE 'hi' END
      WHEN script = 'latin' THEN CASE WHEN regexp_matches(text, '{language.LATIN_ENGLISH}') OR NOT regexp_matches(l, '[^\x{{00}}-\x{{7F}}]') THEN 'en' ELSE 'und' END
      {" ".join(f"WHEN script = '{n}' THEN '{v}'" for n, v in language.BY_SCRIPT.items() if n != "latin")} ELSE 'und' END AS language FROM k"""
)
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("document_id", "seq", language.detect_language(F.col("text")).alias("language"))


_TOKENS = rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^{W}\x{{0B}}\x{{0C}}\x{{1C}}-\x{{1F}}\x{{85}}]+')) AS token,
  generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^{W}\x{{0B}}\x{{0C}}\x{{1C}}-\x{{1F}}\x{{85}}]+'), 1) - 1 AS pos FROM documents),
 e AS (SELECT *, length(token) >= 3 AND NOT regexp_matches(token, '\p{{Nd}}') AND regexp_matches(token, '[\p{{L}}\p{{N}}_]') AS eligible FROM t)"""


@query(
    _TOKENS
    + """, r AS (SELECT *, CASE WHEN eligible AND NOT coalesce(lag(eligible) OVER (PARTITION BY doc_id ORDER BY pos), false)
    THEN 1 ELSE 0 END AS start FROM e)
    SELECT doc_id, count(*) AS tokens, CAST(sum(CASE WHEN eligible THEN 1 ELSE 0 END) AS BIGINT) AS eligible, CAST(sum(start) AS BIGINT) AS runs FROM r GROUP BY doc_id"""
)
def token_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text", F.lit("en").alias("language"), F.lit(0.5).alias("confidence"))
    tokens = spell.eligible_tokens(docs, ["doc_id"])
    return tokens.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("tokens"),
        F.sum(F.col("eligible").cast("long")).alias("eligible"),
        F.count_distinct("run").alias("runs"),
    )


@query(
    _TOKENS
    + rf""", w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^{W}\x{{0B}}\x{{0C}}\x{{1C}}-\x{{1F}}\x{{85}}]+')) AS token FROM benchmark),
    k AS (SELECT e.*, w.token IS NOT NULL AS known FROM e LEFT JOIN w ON e.token = w.token)
    SELECT doc_id, CAST(sum(CASE WHEN eligible THEN 1 ELSE 0 END) AS INTEGER) AS checkable,
      CASE WHEN sum(CASE WHEN eligible THEN 1 ELSE 0 END) > 0 THEN sum(CASE WHEN eligible AND known THEN 1 ELSE 0 END)
        / sum(CASE WHEN eligible THEN 1 ELSE 0 END) ELSE 1.0 END AS hit_rate FROM k GROUP BY doc_id"""
)
def hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text", F.lit("en").alias("language"), F.lit(0.5).alias("confidence"))
    words = _t(spark, sf_dir, "benchmark").select(F.explode(X.tokens(F.col("text"))).alias("word"))
    return spell.hit_rate(spell.eligible_tokens(docs, ["doc_id"]), words, ["doc_id"])


_DICTIONARY = """d AS (SELECT lower(p_type) AS term, count(*) AS n FROM part GROUP BY 1 UNION ALL
  SELECT w, count(*) FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1)"""


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    types = part.groupBy(F.lower("p_type").alias("word")).agg(F.count(F.lit(1)).alias("count"))
    names = part.select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    return types.unionByName(names)


@query(
    f"""WITH {_DICTIONARY}, q AS (SELECT DISTINCT unnest([w, substr(w, 2), w || 'x', replace(w, 'e', 'a'), 'q' || w || 'q']) AS word
      FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part UNION SELECT lower(p_type) FROM part)),
    p AS (SELECT q.word, d.term, d.n, levenshtein(q.word, d.term) AS distance FROM q JOIN d ON levenshtein(q.word, d.term) <= 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, n DESC, term) AS k FROM p)
    SELECT word, term AS suggestion, CAST(distance AS INTEGER) AS distance FROM r WHERE k = 1"""
)
def spell_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _dictionary(spark, sf_dir)
    w = F.col("word")
    bent = F.array(w, F.substring(w, F.lit(2), F.length(w)), F.concat(w, F.lit("x")), F.replace(w, F.lit("e"), F.lit("a")), F.concat(F.lit("q"), w, F.lit("q")))
    return spell.suggestions(known.select(F.explode(bent).alias("word")), known)


def _noisy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    return part.select(
        "p_partkey", F.replace("p_name", F.lit("e"), F.lit("a")).alias("text"), F.lit("gu").alias("language"), F.lit(0.5).alias("confidence")
    )


@query(
    f"""WITH {_DICTIONARY}, t AS (SELECT p_partkey, unnest(string_split(replace(p_name, 'e', 'a'), ' ')) AS w,
      generate_subscripts(string_split(p_name, ' '), 1) AS pos FROM part),
    p AS (SELECT w, d.term, row_number() OVER (PARTITION BY w ORDER BY levenshtein(w, d.term), d.n DESC, d.term) AS k
      FROM (SELECT DISTINCT w FROM t WHERE length(w) >= 3) JOIN d ON levenshtein(w, d.term) <= 2),
    f AS (SELECT t.*, coalesce(p.term, t.w) AS fixed, p.term IS NOT NULL AND p.term <> t.w AS changed
      FROM t LEFT JOIN p ON t.w = p.w AND p.k = 1)
    SELECT p_partkey, string_agg(fixed, ' ' ORDER BY pos) AS corrected_text, CAST(sum(CASE WHEN changed THEN 1 ELSE 0 END) AS INTEGER) AS n_corrections
    FROM f GROUP BY p_partkey"""
)
def spell_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spell.correct_words(_noisy_names(spark, sf_dir), _dictionary(spark, sf_dir), ["p_partkey"])
    return out.select("p_partkey", "corrected_text", F.size("corrections").alias("n_corrections"))


@query()
def spell_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A frequency list of the few distinct words of part names; a real one is a file of bounded length.
    words = spell.word_list(_dictionary(spark, sf_dir))
    out = spell.correct_runs(_noisy_names(spark, sf_dir), words, ["p_partkey"])
    return out.select("p_partkey", "corrected_text", F.size("corrections").alias("n_corrections"))


@query(
    f"""WITH {_DICTIONARY}, t AS (SELECT p_partkey, unnest(string_split(replace(p_name, 'e', 'a'), ' ')) AS w FROM part),
    v AS (SELECT p_partkey, count(*) AS n, count(*) FILTER (w IN (SELECT term FROM d)) AS hi, count(*) FILTER (w IN (SELECT term FROM d WHERE length(term) > 4)) AS mr
      FROM t WHERE length(w) >= 3 GROUP BY p_partkey),
    r AS (SELECT p.p_partkey, coalesce(v.hi / v.n, 1.0) AS hi, coalesce(v.mr / v.n, 1.0) AS mr FROM part p LEFT JOIN v USING (p_partkey))
    SELECT p_partkey, CAST(hi AS DOUBLE) AS hi, CAST(mr AS DOUBLE) AS mr, CASE WHEN hi >= mr THEN 'hi' ELSE 'mr' END AS language FROM r"""
)
def devanagari_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _dictionary(spark, sf_dir)
    return spell.devanagari_votes(_noisy_names(spark, sf_dir), {"hi": known, "mr": known.filter(F.length("word") > 4)}, ["p_partkey"])


# --- blocks ---------------------------------------------------------------------------------------------------


@query(TYPED + " SELECT doc_id AS document_id, type, count(*) AS n FROM b GROUP BY ALL")
def block_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("document_id", "type").agg(F.count(F.lit(1)).alias("n"))


@query(
    TYPED
    + """ SELECT doc_id AS document_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS seq, type, confidence,
    CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM b"""
)
def parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, c = F.col("bbox"), [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")]
    points = F.array(*(F.struct(b[x].alias("x"), b[y].alias("y")) for x, y in c))
    item = F.struct("seq", "text", "confidence", points.alias("points"))
    pages = _lines(spark, sf_dir).groupBy("document_id", "page_number").agg(F.array_sort(F.collect_list(item)).alias("i"))
    raw = pages.select(
        "document_id",
        "page_number",
        F.transform("i", lambda x: x.text).alias("rec_texts"),
        F.concat(F.transform("i", lambda x: x.confidence), F.array(F.lit(0.5))).alias("rec_scores"),
        F.transform("i", lambda x: x.points).alias("rec_polys"),
    )
    return blocks.parse_lines(raw).select("document_id", F.col("seq").cast("long").alias("seq"), "type", "confidence", *_edges())


@query(
    LINES
    + """c AS (SELECT doc_id, seq, greatest(CAST(x0 - 30 AS INTEGER) - 10, 0) AS x0, greatest(y0 - 10, 0) AS y0, least(x1 - 30 + 10, 420) AS x1,
    least(y1 + 10, 300) AS y1 FROM lines)
    SELECT doc_id AS document_id, seq, CAST(x0 AS INTEGER) AS x0, CAST(y0 AS INTEGER) AS y0, CAST(x1 AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1
    FROM c WHERE x1 > x0 AND y1 > y0"""
)
def crop_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("bbox")
    boxes = _lines(spark, sf_dir).select(
        "document_id", "page_number", "seq", F.lit("table").alias("label"), F.array(b.x0 - 30, b.y0, b.x1 - 30, b.y1).alias("coordinate"),
        F.lit(420).alias("page_width"), F.lit(300).alias("page_height"),
    )
    return blocks.table_windows(boxes).select("document_id", "seq", *(F.col(f"window.{e}").alias(e) for e in ("x0", "y0", "x1", "y1")))


@query(
    LINES
    + "SELECT doc_id AS document_id, seq FROM lines t WHERE seq % 7 <> 3 AND NOT EXISTS (SELECT 1 FROM lines s WHERE s.doc_id = t.doc_id AND s.seq % 7 = 3 "
    "AND (t.x1 - t.x0) * (t.y1 - t.y0) > 0 AND greatest(least(t.x1, s.x1) - greatest(t.x0, s.x0), 0) * greatest(least(t.y1, s.y1 + 10) - greatest(t.y0, s.y0), 0) "
    ">= 0.6 * (t.x1 - t.x0) * (t.y1 - t.y0))".replace("lines + ", ""),
)
def suppress_in_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = spatial.suppress_inside(L.with_structures(_lines(spark, sf_dir)))
    return kept.filter("type <> 'figure'").select("document_id", "seq")


def _doubled(lines: DataFrame) -> DataFrame:
    """Every third line once more, shifted by three pixels and with another confidence."""
    b = F.col("bbox")
    again = lines.filter(F.col("seq") % 3 == 1).select(
        "document_id", "page_number", (F.col("seq") + 100000).alias("seq"), "text", G.bbox(b.x0 + 3, b.y0, b.x1 + 3, b.y1).alias("bbox"),
        (1.4995 - F.col("confidence")).alias("confidence"), "language", "type",
    )
    return lines.unionByName(again)


_DOUBLED = (
    TYPED
    + """, u AS (SELECT doc_id, seq, text, x0, y0, x1, y1, confidence, type FROM b UNION ALL
      SELECT doc_id, seq + 100000, text, x0 + 3, y0, x1 + 3, y1, 1.4995 - confidence, type FROM b WHERE seq % 3 = 1),
    g AS (SELECT a.doc_id, a.seq AS a_seq, c.seq AS b_seq, greatest(least(a.x1, c.x1) - greatest(a.x0, c.x0), 0) * greatest(least(a.y1, c.y1) - greatest(a.y0, c.y0), 0) AS i,
        (a.x1 - a.x0) * (a.y1 - a.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) AS t
      FROM u a JOIN u c ON a.doc_id = c.doc_id AND a.type = c.type AND a.seq < c.seq AND a.text = c.text),
    e AS (SELECT doc_id, a_seq, b_seq FROM g WHERE t - i > 0 AND i / (t - i) >= 0.5)"""
)


def _equal_texts() -> F.Column:
    return 1 - X.edit_ratio(F.col("a_text"), F.col("b_text"))


@query(_DOUBLED + " SELECT doc_id AS document_id, a_seq, b_seq FROM e")
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Overlapping blocks have equal texts here, so the edit similarity gives the same pairs and SQL can follow.
    found = spatial.duplicate_edges(_doubled(_lines(spark, sf_dir)), _equal_texts())
    return found.select("document_id", "a_seq", "b_seq")


@query(
    _DOUBLED
    + """ SELECT doc_id AS document_id, seq FROM u WHERE NOT EXISTS (SELECT 1 FROM e JOIN u o ON o.doc_id = e.doc_id
      AND o.seq = CASE WHEN e.a_seq = u.seq THEN e.b_seq ELSE e.a_seq END
      WHERE e.doc_id = u.doc_id AND u.seq IN (e.a_seq, e.b_seq) AND (o.confidence > u.confidence OR (o.confidence = u.confidence AND o.seq < u.seq)))"""
)
def duplicates_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.merge_duplicates(_doubled(_lines(spark, sf_dir)), _equal_texts()).select("document_id", "seq")


#: Copies of every third line of up to 150 characters: the k-th is 3 k pixels further right and has more marks at its end.
_COPIES = 2


def _worn(lines: DataFrame) -> DataFrame:
    b, n, out = F.col("bbox"), F.length("text"), lines
    some = lines.filter((F.col("seq") % 3 == 1) & (n <= 150) & (F.trim("text") == F.col("text")))
    for k in range(1, _COPIES + 1):
        # About 30 percent more characters at each step: one step has a similarity of 0.87, two have 0.77.  Every
        # second line gets 40 percent, which one step alone brings to 0.83.
        more = F.floor(n * F.when(F.col("seq") % 2 == 0, 0.3).otherwise(0.4)).cast("int")
        worn = some.withColumn("text", F.concat("text", F.repeat(F.lit("~"), more * k)))
        worn = worn.withColumn("bbox", G.bbox(b.x0 + 3 * k, b.y0, b.x1 + 3 * k, b.y1)).withColumn("seq", F.col("seq") + 100000 * k)
        out = out.unionByName(worn.withColumn("confidence", F.col("confidence") + (0.0004 * (k if k < 2 else -1))))
    return out


@query(
    TYPED
    + """, w AS (SELECT *, length(text) AS n, CAST(floor(length(text) * CASE WHEN seq % 2 = 0 THEN 0.3 ELSE 0.4 END) AS INTEGER) AS more, x1 - x0 AS wide FROM b
      WHERE seq % 3 = 1 AND length(text) <= 150 AND trim(text) = text),
    v AS (SELECT doc_id, seq AS g, k, seq + 100000 * k AS seq, n + more * k AS n, wide, confidence + 0.0004 * CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END AS confidence
      FROM w, range(3) r(k)),
    e AS (SELECT a.doc_id, a.g, a.k AS a, c.k AS b FROM v a JOIN v c ON a.doc_id = c.doc_id AND a.g = c.g AND a.k <> c.k
      WHERE 2.0 * least(a.n, c.n) / (a.n + c.n) >= 0.85 AND (a.wide - 3.0 * abs(a.k - c.k)) / (a.wide + 3.0 * abs(a.k - c.k)) >= 0.5),
    p AS (SELECT v.doc_id, v.g, v.k, least(v.k, coalesce(min(e.b), v.k)) AS c FROM v LEFT JOIN e ON e.doc_id = v.doc_id AND e.g = v.g AND e.a = v.k GROUP BY v.doc_id, v.g, v.k),
    q AS (SELECT p.doc_id, p.g, p.k, least(p.c, coalesce(min(o.c), p.c)) AS c FROM p LEFT JOIN e ON e.doc_id = p.doc_id AND e.g = p.g AND e.a = p.k
      LEFT JOIN p o ON o.doc_id = e.doc_id AND o.g = e.g AND o.k = e.b GROUP BY p.doc_id, p.g, p.k, p.c),
    r AS (SELECT v.doc_id, v.seq, v.confidence, row_number() OVER (PARTITION BY v.doc_id, v.g, q.c ORDER BY v.confidence DESC, v.seq) AS place FROM v JOIN q USING (doc_id, g, k)),
    u AS (SELECT doc_id, seq, confidence FROM b WHERE NOT (seq % 3 = 1 AND length(text) <= 150 AND trim(text) = text) UNION ALL SELECT doc_id, seq, confidence FROM r WHERE place = 1)
    SELECT doc_id AS document_id, seq, round(confidence, 9) AS confidence FROM u"""
)
def duplicates_gestalt(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spatial.merge_duplicates(_worn(_lines(spark, sf_dir)))
    return found.select("document_id", F.col("seq").cast("long").alias("seq"), F.round("confidence", 9).alias("confidence"))


@query(
    LINES
    + """t AS (SELECT *, CASE WHEN seq % 5 = 2 THEN 'Figure ' || seq || ' ' || text ELSE text END AS said FROM lines),
    r AS (SELECT s.doc_id, s.seq, t.said, greatest(t.y0 - (s.y1 + 10), s.y0 - t.y1, 0) AS gap, t.seq AS t_seq
      FROM lines s JOIN t ON s.doc_id = t.doc_id AND s.seq % 7 = 3 AND t.seq % 5 = 2 AND t.x1 >= s.x0 AND t.x0 <= s.x1),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, seq ORDER BY gap, t_seq DESC) AS n FROM r WHERE gap <= 80)
    SELECT l.doc_id AS document_id, l.seq, md5(rtrim(k.said)) AS caption, NOT (l.confidence >= 0.85 AND k.said IS NOT NULL) AS needs_review
    FROM lines l LEFT JOIN k ON l.doc_id = k.doc_id AND l.seq = k.seq AND k.n = 1 WHERE l.seq % 7 = 3"""
)
def figure_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    said = F.when(F.col("seq") % 5 == 2, F.concat(F.lit("Figure "), F.col("seq"), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    regions = L.structures(lines).select(
        "document_id", "page_number", "seq", "bbox", "confidence", F.lit("image").alias("subtype"),
        F.lit(L.PAGE_WIDTH).alias("page_width"), F.lit(1 << 20).alias("page_height"),
    )
    out = blocks.figure_blocks(regions, lines.withColumn("text", said))
    return out.select("document_id", "seq", F.md5("caption").alias("caption"), "needs_review")


@query(
    TYPED
    + """, m AS (SELECT *, seq % 4 <> 0 AS twice, greatest(x1 - x0 - 20, 0) * (y1 - y0 - 3) AS i FROM b),
    n AS (SELECT *, twice AND i / (2.0 * (x1 - x0) * (y1 - y0) - i) >= 0.3 AS hit, 1.4995 - confidence AS other FROM m),
    u AS (SELECT doc_id, 0 AS part, seq, text, lang, type, CASE WHEN hit AND confidence > other THEN confidence ELSE other END AS confidence,
        CASE WHEN hit AND confidence > other THEN 'primary' ELSE 'fallback' END AS engine_used FROM n WHERE twice
      UNION ALL SELECT doc_id, 1, seq, text, lang, type, confidence, 'primary' FROM n WHERE NOT hit)
    SELECT doc_id AS document_id, 1 AS page_number, row_number() OVER (PARTITION BY doc_id ORDER BY part, seq) - 1 AS seq, md5(text) AS text,
      round(confidence, 9) AS confidence, lang AS language, type, engine_used FROM u"""
)
def engine_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, b = _lines(spark, sf_dir), F.col("bbox")
    second = lines.filter(F.col("seq") % 4 != 0).withColumn("bbox", G.bbox(b.x0 + 20, b.y0 + 3, b.x1 + 20, b.y1 + 3))
    second = second.withColumn("confidence", 1.4995 - F.col("confidence"))
    merged = spatial.merge_engines(lines, second).drop("bbox").withColumn("seq", F.col("seq").cast("long"))
    return merged.withColumn("text", F.md5("text")).withColumn("confidence", F.round("confidence", 9))


# --- order ----------------------------------------------------------------------------------------------------


@query(
    LINES
    + """o AS (SELECT doc_id, seq, dense_rank() OVER (PARTITION BY doc_id ORDER BY x0) AS c,
      row_number() OVER (PARTITION BY doc_id ORDER BY x0, y0, seq) AS r FROM lines)
    SELECT doc_id AS document_id, seq, CAST(c AS INTEGER) AS column_number, CAST(r AS INTEGER) AS reading_order, 'p1_b' || r AS block_id FROM o"""
)
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = layout.reading_order(_lines(spark, sf_dir))
    return out.select("document_id", "seq", "column_number", "reading_order", "block_id")


@query(
    LINES
    + "o AS (SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY y0, x0, seq) AS r FROM lines) "
    "SELECT doc_id AS document_id, seq, 'p1_b' || r AS block_id FROM o"
)
def page_blocks_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_order(_lines(spark, sf_dir)).select("document_id", "seq", "block_id")


@query(
    LINES
    + """a AS (SELECT doc_id, seq, k, CAST(500 + (31 * doc_id + 17 * seq + 113 * k) % 500 AS DOUBLE) / 1000 AS confidence FROM lines, range(3) r(k)),
    m AS (SELECT *, max(confidence) OVER (PARTITION BY doc_id, seq ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM a),
    t AS (SELECT * FROM m WHERE k <= 1 OR p < 0.85),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, seq ORDER BY confidence DESC, k) AS n, count(*) OVER (PARTITION BY doc_id, seq) AS tried FROM t)
    SELECT doc_id AS document_id, seq, CAST(k AS INTEGER) AS attempt, confidence, tried FROM r WHERE n = 1"""
)
def best_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = _lines(spark, sf_dir).select("document_id", "seq", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("attempt"))
    c = (500 + (31 * F.col("document_id") + 17 * F.col("seq") + 113 * F.col("attempt")) % 500) / 1000
    return layout.best_attempt(tries.withColumn("confidence", c), ["document_id", "seq"], 0.85)


# --- quality --------------------------------------------------------------------------------------------------

_COMMON = rf"{W}\x{{0B}}\x{{0C}}\x{{1C}}-\x{{1F}}\x{{85}}{X.DIGITS}\p{{P}}"
_QUALITY = (
    TYPED
    + rf""", x AS (SELECT *, length(text) AS n, length(regexp_replace(text, '[^{_COMMON}]', '', 'g')) + CASE WHEN lang = 'en'
      THEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) ELSE 0 END AS e FROM b),
    q AS (SELECT doc_id, avg(confidence) AS confidence, 1.0 AS text_quality, sum(e) / sum(n) AS character_quality,
      least(sum((x1 - x0) * (y1 - y0)) / {L.PAGE_WIDTH * L.PAGE_HEIGHT}.0, 1.0) AS coverage, 1.0 AS language_consistency FROM x GROUP BY doc_id),
    s AS (SELECT *, 0.35 * confidence + 0.25 + 0.15 * character_quality + 0.15 * coverage + 0.10 AS quality_score FROM q)"""
)


def _sized(df: DataFrame) -> DataFrame:
    return df.withColumn("page_width", F.lit(L.PAGE_WIDTH)).withColumn("page_height", F.lit(L.PAGE_HEIGHT))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) if c in names else F.col(c) for c in df.columns))


_PARTS = ("confidence", "text_quality", "character_quality", "coverage", "language_consistency", "quality_score")


@query(
    _QUALITY
    + " SELECT doc_id AS document_id, "
    + ", ".join(f"round(CAST({c} AS DOUBLE), 9) AS {c}" for c in _PARTS)
    + " FROM s"
)
def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quality.page_quality(_sized(_lines(spark, sf_dir)), ["document_id"]), *_PARTS)


@query(
    _QUALITY
    + """ SELECT d.source, count(*) AS pages, round(avg(s.quality_score), 9) AS quality_score FROM s JOIN documents d USING (doc_id) GROUP BY d.source"""
)
def document_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.page_quality(_sized(_lines(spark, sf_dir)))
    sources = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "source")
    return _rounded(quality.document_quality(scored.join(sources, "document_id"), "source"), "quality_score")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page quality by language and label: scan, lines, clean-up, five components, tiers, join, aggregate, order."""
    lines = _lines(spark, sf_dir).withColumn("text", X.clean_text(F.col("text"), compose=False))
    scored = quality.page_quality(_sized(lines))
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "lang")
    labels = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), F.col("quality").alias("label"))
    joined = scored.join(docs, "document_id").join(labels, "document_id", "left")
    tier = quality.review_status(F.col("quality_score"))
    out = joined.groupBy("lang", "label", tier.alias("tier")).agg(
        F.count(F.lit(1)).alias("pages"), F.round(F.avg("quality_score"), 9).alias("quality_score")
    )
    return out.orderBy("lang", "label", "tier")


@query(
    _QUALITY.replace("lines AS (", "raw AS (", 1).replace(
        "b AS (SELECT *, CASE WHEN", rf"lines AS (SELECT * REPLACE (trim(regexp_replace(regexp_replace(text, '[\x{{FFFD}}{X.CONTROLS}]', '', 'g'), '[{W}]+', ' ', 'g')) AS text) FROM raw), b AS (SELECT *, CASE WHEN", 1
    )
    + """ SELECT lang, quality AS label, CASE WHEN quality_score >= 0.9 THEN 'accepted' WHEN quality_score >= 0.75 THEN 'flagged' ELSE 'needs_review' END AS tier,
      count(*) AS pages, round(avg(quality_score), 9) AS quality_score
    FROM s JOIN documents d USING (doc_id) LEFT JOIN (SELECT doc_id, quality FROM labels) USING (doc_id) GROUP BY ALL"""
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


@query(
    LINES
    + """p AS (SELECT doc_id, avg(confidence) AS m, round(avg(confidence), 4) AS c FROM lines GROUP BY doc_id)
    SELECT d.doc_id AS document_id, coalesce(p.c, 0.0) AS avg_confidence, coalesce(p.m, 0) < 0.8 AS low FROM documents d LEFT JOIN p USING (doc_id)"""
)
def document_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    pages = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"))
    low = quality.low_confidence_pages(pages, lines).select("document_id", (F.size("low_confidence_pages") > 0).alias("low"))
    joined = low.join(quality.document_confidence(lines), "document_id", "left")
    return joined.select("document_id", F.coalesce("avg_confidence", F.lit(0.0)).alias("avg_confidence"), "low")


@query("SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages FROM documents WHERE trim(text) <> '' GROUP BY source")
def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").filter(F.trim("text") != "")
    rows = docs.select("source", F.col("lang").alias("language"), F.lit("paragraph").alias("type"))
    return quality.page_languages(rows, ["source"]).select("source", F.array_join("languages", ",").alias("languages"))


_TIER = "CASE WHEN confidence >= 0.9 THEN 'accepted' WHEN confidence >= 0.75 THEN 'flagged' ELSE 'needs_review' END"


@query(
    TYPED
    + f""", r AS (SELECT doc_id, CASE WHEN seq % 7 = 3 THEN 'figure' ELSE type END AS type, {_TIER} AS review_status, confidence, seq FROM b)
    SELECT type, review_status, CASE WHEN type = 'figure' THEN seq % 2 = 0 OR review_status = 'needs_review' ELSE review_status = 'needs_review' END AS needs_review,
      count(*) AS n FROM r GROUP BY ALL"""
)
def review_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.with_structures(_lines(spark, sf_dir)).withColumn("needs_review", F.col("seq") % 2 == 0)
    return quality.review_routing(rows).groupBy("type", "review_status", "needs_review").agg(F.count(F.lit(1)).alias("n"))


@query(
    _QUALITY
    + """ SELECT doc_id AS document_id, CASE WHEN confidence >= 0.85 AND quality_score >= 0.7 THEN 'accept' ELSE 'retry' END AS route,
    CAST((confidence < 0.85)::INT + (quality_score < 0.7)::INT AS INTEGER) AS n_reasons FROM s"""
)
def route_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = routing.page_signals(_sized(_lines(spark, sf_dir)))
    return routing.route(signals).select("document_id", "route", F.size("reasons").alias("n_reasons"))


def _better(lines: DataFrame, more: F.Column) -> Callable[[DataFrame], DataFrame]:
    def recognise(pages: DataFrame) -> DataFrame:
        return lines.join(pages, blocks.PAGE, "left_semi").withColumn("confidence", F.least(F.col("confidence") + more, F.lit(1.0)))

    return recognise


def _failing(recognise, fails: F.Column) -> Callable[[DataFrame], DataFrame]:
    """The recogniser with errors in place of the blocks of some pages."""

    def run(pages: DataFrame) -> DataFrame:
        bad = pages.filter(fails).withColumn("error", F.lit("out of memory"))
        return recognise(pages.filter(~fails)).unionByName(bad, allowMissingColumns=True)

    return run


@query(
    _QUALITY
    + rf""", t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\p{{L}}]', '', 'g') AS l FROM documents),
    f AS (SELECT doc_id, length(l) AS letters, {_FAMILIES} FROM t), x2 AS (SELECT doc_id, letters > 0 AND ({_COUNT}) >= 2 AND ({_OTHERS}) AS mixed FROM f),
    base AS (SELECT d.doc_id, s.doc_id IS NULL OR d.doc_id % 50 = 7 AS blank, s.doc_id IS NOT NULL AS any, s.confidence AS c, s.quality_score AS q, x2.mixed
      FROM documents d LEFT JOIN s USING (doc_id) JOIN x2 USING (doc_id)),
    v AS (SELECT doc_id, avg(least(confidence + 0.1, 1.0)) AS c1, avg(least(confidence + CASE WHEN doc_id % 3 = 0 THEN 0.12 ELSE 0.02 END, 1.0)) AS c2 FROM lines GROUP BY doc_id),
    p AS (SELECT base.*, CASE WHEN blank THEN 0 ELSE c END AS c0, CASE WHEN blank THEN 0.85 ELSE q END AS q0, NOT blank AND mixed AS m0,
      CASE WHEN doc_id % 5 <> 0 THEN c1 END AS c1, c2 FROM base LEFT JOIN v USING (doc_id)),
    r AS (SELECT *, (c0 < 0.85 OR q0 < 0.7) AND NOT m0 AS retry FROM p),
    b1 AS (SELECT *, CASE WHEN retry AND coalesce(c1, 0) > c0 THEN 1 ELSE 0 END AS a1, CASE WHEN retry AND coalesce(c1, 0) > c0 THEN c1 ELSE c0 END AS e1 FROM r),
    b2 AS (SELECT *, CASE WHEN retry AND e1 < 0.85 AND coalesce(c2, 0) > e1 THEN 2 ELSE a1 END AS att, CASE WHEN retry AND e1 < 0.85 AND coalesce(c2, 0) > e1 THEN c2 ELSE e1 END AS cf FROM b1),
    z AS (SELECT *, CASE WHEN att > 0 THEN q + 0.35 * (cf - c) ELSE q0 END AS qf, CASE WHEN att > 0 THEN mixed ELSE m0 END AS mf FROM b2),
    o AS (SELECT *, cf >= 0.85 AND qf >= 0.7 AND NOT mf AS accepted, ['original', 'enhanced', 'threshold'][att + 1] AS named FROM z),
    l AS (SELECT o.doc_id, accepted OR doc_id % 4 = 1 AS stands, doc_id % 4 = 2 AS nothing, NOT blank OR att > 0 AS have, lines.confidence AS raw,
      CASE att WHEN 1 THEN least(lines.confidence + 0.1, 1.0) WHEN 2 THEN least(lines.confidence + CASE WHEN doc_id % 3 = 0 THEN 0.12 ELSE 0.02 END, 1.0) ELSE lines.confidence END AS own
      FROM o JOIN lines USING (doc_id)),
    g AS (SELECT doc_id, CASE WHEN stands OR nothing THEN CASE WHEN have THEN 'primary' END WHEN have AND own > least(1.3 - raw, 1.0) THEN 'primary' ELSE 'fallback' END AS engine FROM l)
    SELECT o.doc_id AS document_id, CASE WHEN accepted OR o.doc_id % 4 = 1 THEN named ELSE 'fallback' END AS ocr_attempt,
      count(*) FILTER (engine = 'primary') AS from_primary, count(*) FILTER (engine = 'fallback') AS from_fallback
    FROM o LEFT JOIN g USING (doc_id) GROUP BY ALL"""
)
def process_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank pages, a variant that fails on every fifth page, a fallback that fails on some pages and is blind on others."""
    # Recogniser output would be a stored table; the lines stand for it and are split once.
    lines = kept(_lines(spark, sf_dir), "lines")
    pages = _sized(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number")))
    k = F.col("document_id")
    primary = lines.filter(k % 50 != 7)
    second = F.when(k % 3 == 0, 0.12).otherwise(0.02)
    variants = [("enhanced", _failing(_better(lines, F.lit(0.1)), k % 5 == 0)), ("threshold", _better(lines, second))]
    seen = _better(lines.filter(k % 4 != 2), F.lit(1.3) - 2 * F.col("confidence"))
    found, attempts = routing.run_pages(primary, variants, _failing(seen, k % 4 == 1), pages=pages)
    counted = found.groupBy("document_id").agg(
        *(F.sum(F.when(F.col("engine_used") == e, 1).otherwise(0)).alias(f"from_{e}") for e in ("primary", "fallback"))
    )
    return attempts.join(counted, "document_id", "left").select(
        "document_id", "ocr_attempt", *(F.coalesce(f"from_{e}", F.lit(0)).alias(f"from_{e}") for e in ("primary", "fallback"))
    )


# --- correction -----------------------------------------------------------------------------------------------


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correction of all lines: a cache for every fifth, answers that are missing, equal, near or empty for the rest."""
    lines = _lines(spark, sf_dir)
    keyed = lines.select("seq", "document_id", "text", correction.cache_key(F.col("text"), F.col("language")).alias("key"))
    chars = F.length("text")
    cache = keyed.select("key", F.concat("text", F.lit("~")).alias("corrected_text")).filter(F.pmod(F.length("corrected_text"), F.lit(5)) == 0)
    answer = (
        F.when(chars % 4 == 1, F.col("text")).when(chars % 4 == 2, F.concat("text", F.lit("!!"))).when(chars % 4 == 3, F.lit(""))
    )
    answers = keyed.select("key", answer.alias("answer"), (chars % 11 == 0).alias("failed"))
    return correction.apply_answers(correction.precheck(lines, cache), answers)


_ANSWERED = (
    LINES
    + """c AS (SELECT doc_id, seq, length(text) AS n, sha256(lang || chr(0) || text) AS k, text, confidence,
      CASE WHEN confidence >= 0.98 THEN 'skipped_high_confidence' WHEN (length(text) + 1) % 5 = 0 THEN 'cache_hit'
        WHEN length(text) % 11 = 0 THEN 'api_error' WHEN length(text) % 4 = 0 THEN 'invalid_response' WHEN length(text) % 4 = 1 THEN 'ok'
        WHEN length(text) % 4 = 2 THEN CASE WHEN 2.0 / (length(text) + 2) > 0.3 THEN 'edit_distance_rejected' ELSE 'ok' END
        ELSE 'edit_distance_rejected' END AS correction_reason FROM lines)"""
)


@query(
    _ANSWERED
    + """ SELECT doc_id AS document_id, seq, correction_reason, correction_reason = 'cache_hit' OR (correction_reason = 'ok' AND n % 4 = 2) AS correction_applied,
      md5(CASE WHEN correction_reason = 'cache_hit' THEN text || '~' WHEN correction_reason = 'ok' AND n % 4 = 2 THEN text || '!!' ELSE text END) AS corrected FROM c"""
)
def correction_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _answered(spark, sf_dir)
    return out.select("document_id", "seq", "correction_reason", "correction_applied", F.md5("corrected_text").alias("corrected"))


@query(LINES + "k AS (SELECT DISTINCT lang, sha256(lang || chr(0) || text) AS k FROM lines WHERE confidence < 0.98) SELECT lang AS language, count(*) AS requests FROM k GROUP BY lang")
def correction_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = correction.distinct_requests(correction.precheck(_lines(spark, sf_dir)))
    return asked.groupBy("language").agg(F.count(F.lit(1)).alias("requests"))


@query("SELECT p_partkey, (p_size - 1) % 6 + 1 AS attempt, least(1.0 * power(2.0, (p_size - 1) % 6), 30.0) AS delay FROM part")
def server_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("p_size") - 1) % 6 + 1
    return _t(spark, sf_dir, "part").select("p_partkey", n.alias("attempt"), correction.server_backoff(n).alias("delay"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 1 END AS n_corrections, CASE WHEN p_size % 3 <> 0 THEN p_name END AS corrected FROM part"""
)
def parse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = '{"block_id": "p1", "corrected_text": "%s"}'
    body = F.format_string('```json\n{"corrections": [' + pair + ", " + pair + ', {"block_id": 7}, 3]}\n```', F.lit("old"), F.col("p_name"))
    raw = F.when(F.col("p_size") % 3 == 0, F.lit("no object")).otherwise(body)
    found = _t(spark, sf_dir, "part").select("p_partkey", correction.parse_response(raw).alias("m"))
    n = F.when(F.col("m").isNotNull(), F.size(F.map_keys("m")))
    return found.select("p_partkey", n.alias("n_corrections"), F.try_element_at("m", F.lit("p1")).alias("corrected"))


# --- assembly and export --------------------------------------------------------------------------------------


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(_lines(spark, sf_dir))


_ORDERED = TYPED + ", o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY x0, y0, seq) AS r FROM b)"


@query(
    _ORDERED
    + r""" SELECT doc_id AS document_id, md5('<!-- Page 1 -->' || chr(10) || chr(10) ||
      string_agg(CASE WHEN type = 'heading' THEN '# ' ELSE '' END || text || chr(10), chr(10) ORDER BY r) || chr(10) || chr(10)) AS digest FROM o GROUP BY doc_id"""
)
def markdown_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.markdown(_ordered(spark, sf_dir)).select("document_id", F.md5("body").alias("digest"))


@query(
    _ORDERED
    + r""" SELECT doc_id AS document_id, md5('==================== Page 1 ====================' || chr(10) || chr(10) ||
      string_agg(text, chr(10) ORDER BY r) || chr(10)) AS digest FROM o GROUP BY doc_id"""
)
def text_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.plain_text(_ordered(spark, sf_dir)).select("document_id", F.md5("body").alias("digest"))


@query(LINES + "SELECT doc_id AS document_id, md5(string_agg(text, ' ' ORDER BY seq)) AS digest FROM lines GROUP BY doc_id")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search_text(_lines(spark, sf_dir), ["document_id"]).select("document_id", F.md5("search_text").alias("digest"))


_REVIEWED = "CASE WHEN confidence >= 0.9 THEN 'accepted' WHEN confidence >= 0.75 THEN 'flagged' ELSE 'needs_review' END"


@query(
    _QUALITY
    + f""", o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY x0, y0, seq) AS r FROM b),
    n AS (SELECT doc_id, md5(string_agg('p1_b' || r || '/' || type || '/' || {_REVIEWED} || '/' || round(x0) || '/' || text, chr(10) ORDER BY r)) AS blocks, count(*) AS n_blocks FROM o GROUP BY doc_id),
    m AS (SELECT s.doc_id, quality_score, confidence, n.n_blocks, n.blocks FROM s JOIN n USING (doc_id))
    SELECT d.doc_id AS document_id, d.source AS filename, 2 AS page_count, CASE WHEN m.doc_id IS NULL THEN CAST(0.85 AS DOUBLE) ELSE round(CAST(quality_score AS DOUBLE), 4) END AS quality_score,
      CAST(0.85 AS DOUBLE) AS blank_quality, round(CAST((coalesce(quality_score, 0.85) + 0.85) / 2 AS DOUBLE), 9) AS avg_quality_score, coalesce(round(confidence, 4), 0.0) AS avg_confidence,
      CASE WHEN coalesce(confidence, 0) < 0.8 THEN '1,2' ELSE '2' END AS low_confidence_pages, CASE WHEN m.doc_id IS NULL THEN '' ELSE d.lang END AS languages,
      'original,enhanced' AS attempts, coalesce(n_blocks, 0) AS n_blocks, blocks
    FROM documents d LEFT JOIN m USING (doc_id)"""
)
def document_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of every document as JSON, read back; the second page of each is blank."""
    corrected = correction.correct_blocks(quality.review_routing(_ordered(spark, sf_dir))).withColumn("engine_used", F.lit("primary"))
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("filename"))
    pages = docs.select("document_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("page_number"))
    pages = _sized(pages.withColumn("ocr_attempt", F.when(F.col("page_number") == 2, "enhanced")))
    tree = assemble.document_tree(docs, pages, corrected)
    block = "struct<block_id:string,type:string,review_status:string,bbox:array<double>,text:string>"
    page = f"struct<quality_score:double,language_detected:array<string>,ocr_attempt:string,blocks:array<{block}>>"
    shape = f"struct<filename:string,page_count:int,pages:array<{page}>,metadata:struct<avg_confidence:double,low_confidence_pages:array<int>>>"
    # What SQL checks is read from the JSON; the mean of the scores is not part of it.
    both = assemble.to_json(tree.withColumn("filename", F.concat_ws("|", "filename", quality.rounded(F.col("avg_quality_score"), 9).cast("string"))))
    j = both.select("document_id", F.from_json("json", shape).alias("j")).select("document_id", "j.*")
    said = F.split("filename", "\\|")
    first = F.transform(
        F.col("pages")[0].blocks,
        lambda b: F.concat_ws("/", b.block_id, b["type"], b.review_status, F.round(b.bbox[0]).cast("long").cast("string"), b.text),
    )
    return j.select(
        "document_id",
        said[0].alias("filename"),
        "page_count",
        F.col("pages")[0].quality_score.alias("quality_score"),
        F.col("pages")[1].quality_score.alias("blank_quality"),
        said[1].cast("double").alias("avg_quality_score"),
        "metadata.avg_confidence",
        F.array_join(F.col("metadata.low_confidence_pages").cast("array<string>"), ",").alias("low_confidence_pages"),
        F.array_join(F.flatten(F.col("pages").language_detected), ",").alias("languages"),
        F.array_join(F.col("pages").ocr_attempt, ",").alias("attempts"),
        F.size(first).cast("long").alias("n_blocks"),
        F.when(F.size(first) > 0, F.md5(F.array_join(first, "\n"))).alias("blocks"),
    )


def _order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table for each order: three columns, a row for each line number; the first column spans gaps."""
    cells = _t(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        (F.col("l_linenumber") - 1).alias("row"),
        F.posexplode(F.array(F.concat(F.lit("a|"), F.col("l_partkey")), F.col("l_suppkey").cast("string"), F.concat("l_returnflag", F.lit("\n"), "l_linestatus"))).alias("col", "text"),
    )
    cell = F.struct("row", "col", F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), "text", (F.col("row") == 0).alias("is_header"), F.lit(1.0).alias("confidence"))
    return cells.groupBy("l_orderkey").agg(
        F.struct((F.max("row") + 1).alias("rows"), F.lit(3).alias("cols"), F.array_sort(F.collect_list(cell)).alias("cells")).alias("table")
    )


_ORDER_GRID = """WITH m AS (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY 1),
  g AS (SELECT m.l_orderkey, unnest(range(1, m.n + 1)) AS k FROM m),
  c AS (SELECT l_orderkey, l_linenumber, max(%s || l_partkey) AS a, max(CAST(l_suppkey AS VARCHAR)) AS b, max(l_returnflag || ' ' || l_linestatus) AS f
    FROM lineitem GROUP BY 1, 2),
  r AS (SELECT g.l_orderkey, g.k, coalesce(c.a, '') AS a, coalesce(c.b, '') AS b, coalesce(c.f, '') AS f
    FROM g LEFT JOIN c ON g.l_orderkey = c.l_orderkey AND g.k = c.l_linenumber)"""


@query(
    _ORDER_GRID % "'a\\|'"
    + """, l AS (SELECT l_orderkey, k, '| ' || a || ' | ' || b || ' | ' || f || ' |' || CASE WHEN k = 1 THEN chr(10) || '| --- | --- | --- |' ELSE '' END AS line FROM r)
    SELECT l_orderkey, md5(string_agg(line, chr(10) ORDER BY k)) AS digest FROM l GROUP BY l_orderkey"""
)
def grid_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_tables(spark, sf_dir).select("l_orderkey", F.md5(tables.markdown_table(F.col("table"))).alias("digest"))


@query(
    _ORDER_GRID % "'a|'"
    + " SELECT l_orderkey, md5(string_agg(a || chr(9) || b || chr(9) || f, chr(10) ORDER BY k)) AS digest FROM r GROUP BY l_orderkey"
)
def grid_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_tables(spark, sf_dir).select("l_orderkey", F.md5(tables.text_table(F.col("table"))).alias("digest"))


@query(
    """SELECT p_partkey, 2 AS n_rows, 3 AS n_cols, 5 AS n_cells, p_name || '/' || p_brand || '/' || p_type || '/' || p_size AS texts, 0.5 AS confidence FROM part"""
)
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.format_string(
        "<p>x</p><table><tr><th colspan=2> %s </th><td rowspan='2'>%s</td></tr><tr><td><b>%s</b></td><td>%s</td></table><table><tr><td>no</table>",
        "p_name", "p_brand", "p_type", "p_size",
    )
    scores = F.array(F.lit(0.9), F.lit(0.8), F.lit(0.3), F.lit(0.0))
    part = _t(spark, sf_dir, "part").select("p_partkey", tables.html_table(html, scores).alias("t"))
    return part.select(
        "p_partkey",
        F.col("t.rows").alias("n_rows"),
        F.col("t.cols").alias("n_cols"),
        (F.size("t.cells") + 1).alias("n_cells"),
        F.array_join(F.transform("t.cells", lambda c: c.text), "/").alias("texts"),
        tables.table_confidence(F.col("t")).alias("confidence"),
    )


_FONT = "CASE lang WHEN 'hi' THEN 'notosans-deva' WHEN 'mr' THEN 'notosans-deva' WHEN 'gu' THEN 'notosans-gujr' ELSE 'notosans-latn' END"


@query(
    LINES
    + f"""e AS (SELECT *, greatest(x1 - x0, 1.0) AS w, greatest(y1 - y0, 1.0) AS h FROM lines)
    SELECT doc_id AS document_id, seq, CAST(x0 AS DOUBLE) AS x, round(CAST(y0 + h * 0.85 AS DOUBLE), 6) AS y,
      round(CAST(greatest(4.0, least(w / length(text) / 0.5, h * 0.9, 72.0)) AS DOUBLE), 6) AS size, {_FONT} AS font FROM e"""
)
def searchable_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = export.searchable_draws(_lines(spark, sf_dir).withColumn("reading_order", F.col("seq")))
    return rows.select(
        "document_id", F.col("reading_order").alias("seq"), "x", F.round("y", 6).alias("y"), F.round("size", 6).alias("size"), "font"
    )


@query(
    LINES
    + """p AS (SELECT DISTINCT d.source, l.doc_id, l.lang FROM lines l JOIN documents d USING (doc_id)),
    j AS (SELECT p.source, p.doc_id, q.lang FROM (SELECT DISTINCT source, doc_id FROM p) p JOIN p q ON p.source = q.source AND q.doc_id <= p.doc_id)
    SELECT source AS document_id, doc_id AS page_number, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages FROM j GROUP BY ALL"""
)
def highlight_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "source")
    rows = _lines(spark, sf_dir).join(sources, "document_id").select(
        F.col("source").alias("document_id"), F.col("document_id").alias("page_number"), "text", "language"
    )
    return export.legend(rows).select("document_id", "page_number", F.array_join("languages", ",").alias("languages"))


@query(
    TYPED
    + """ SELECT doc_id AS document_id, seq, 'text' AS kind, CAST(x0 AS DOUBLE) AS x, CAST(y0 AS DOUBLE) AS y, round(CAST(least(11.0, greatest(6.0, (y1 - y0) * 0.7)) AS DOUBLE), 6) AS size FROM b"""
)
def structured_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("reading_order", F.col("seq")).withColumn("image_url", F.lit(None).cast("string"))
    out = export.structured_draws(rows)
    return out.select("document_id", F.col("reading_order").alias("seq"), "kind", "x", "y", F.round("size", 6).alias("size"))


@query(
    LINES
    + """k AS (SELECT * FROM lines t WHERE seq % 7 <> 3 AND NOT EXISTS (SELECT 1 FROM lines s WHERE s.doc_id = t.doc_id AND s.seq % 7 = 3
        AND (t.x1 - t.x0) * (t.y1 - t.y0) > 0
        AND greatest(least(t.x1, s.x1) - greatest(t.x0, s.x0), 0) * greatest(least(t.y1, s.y1 + 10) - greatest(t.y0, s.y0), 0) >= 0.6 * (t.x1 - t.x0) * (t.y1 - t.y0)))
    SELECT doc_id AS document_id, count(*) AS texts FROM k GROUP BY doc_id"""
)
def postprocess_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = L.postprocess(L.with_structures(_lines(spark, sf_dir)))
    return done.filter("type <> 'figure'").groupBy("document_id").agg(F.count(F.lit(1)).alias("texts"))


@query(
    TYPED
    + rf""", k AS (SELECT * FROM b t WHERE seq % 7 = 3 OR NOT EXISTS (SELECT 1 FROM lines s WHERE s.doc_id = t.doc_id AND s.seq % 7 = 3
        AND (t.x1 - t.x0) * (t.y1 - t.y0) > 0
        AND greatest(least(t.x1, s.x1) - greatest(t.x0, s.x0), 0) * greatest(least(t.y1, s.y1 + 10) - greatest(t.y0, s.y0), 0) >= 0.6 * (t.x1 - t.x0) * (t.y1 - t.y0))),
    c AS (SELECT *, trim(regexp_replace(regexp_replace(nfc_normalize(text), '[\x{{FFFD}}{X.CONTROLS}]', '', 'g'), '[{W}]+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY x0, y0, seq) AS r FROM k)
    SELECT doc_id AS document_id, '<!-- Page 1 -->' || chr(10) || chr(10) || string_agg(CASE WHEN seq % 7 = 3 THEN chr(10) || '![figure]()' || chr(10)
      WHEN type = 'heading' THEN '# ' || t || chr(10) ELSE t || chr(10) END, chr(10) ORDER BY r) || chr(10) || chr(10) AS body FROM c GROUP BY doc_id"""
)
def documents_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.documents_to_markdown(L.with_structures(_lines(spark, sf_dir)))


# --- catalog and search ---------------------------------------------------------------------------------------


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "document_id")


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("document_id"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("started_at"), F.col("o_totalprice").alias("avg_confidence"),
    )


@query(
    """WITH j AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders)
    SELECT c_custkey AS document_id, o_orderkey AS job_id, o_orderstatus AS status FROM customer LEFT JOIN j ON c_custkey = o_custkey AND n = 1"""
)
def latest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = catalog.latest_job(_documents(spark, sf_dir).select("document_id"), _jobs(spark, sf_dir))
    return out.select("document_id", "job_id", "status")


@query(
    """WITH d AS (SELECT c_custkey, CAST(c_acctbal * 100 AS BIGINT) AS uploaded_at FROM customer ORDER BY 2 DESC, 1 LIMIT 10 OFFSET 20),
    j AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders)
    SELECT c_custkey AS document_id, uploaded_at, o_orderkey AS job_id, o_orderstatus AS status FROM d LEFT JOIN j ON c_custkey = o_custkey AND n = 1"""
)
def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("document_id", F.round(F.col("c_acctbal") * 100).cast("long").alias("uploaded_at"))
    return catalog.list_documents(docs, _jobs(spark, sf_dir), 10, 20).select("document_id", "uploaded_at", "job_id", "status")


@query(
    """WITH g AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3), j AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM g)),
    l AS (SELECT count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM j))
    SELECT 'documents' AS name, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM g) UNION ALL
    SELECT 'jobs', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM j) UNION ALL
    SELECT 'pages', n FROM l UNION ALL SELECT 'blocks', n FROM l"""
)
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("page_id")
    items = _t(spark, sf_dir, "lineitem")
    docs = _documents(spark, sf_dir)
    left = catalog.cascade_delete(
        docs, _jobs(spark, sf_dir), items.select(page, F.col("l_orderkey").alias("job_id")), items.select(page), docs.filter("c_nationkey = 3")
    )
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, t in zip(("documents", "jobs", "pages", "blocks"), left)]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query(
    r"""WITH u AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'C:\in\doc' || page_id || '.txt' ELSE 'in/doc' || page_id || '.PDF' END AS f,
      CASE WHEN page_id % 7 = 1 THEN 'text/html' ELSE 'application/pdf' END AS t, CASE WHEN page_id % 11 = 2 THEN 0 ELSE strlen(html) * 9000 END AS size,
      CASE WHEN page_id % 13 = 3 THEN '<html' ELSE '%PDF-' END AS m, CASE WHEN page_id % 17 = 4 THEN NULL ELSE page_id % 19 END AS pages FROM pages)
    SELECT page_id, regexp_extract(replace(f, '\', '/'), '[^/]*$') AS filename,
      CASE WHEN NOT lower(f) LIKE '%.pdf' THEN 'extension' WHEN t = 'text/html' THEN 'content_type' WHEN size = 0 THEN 'empty' WHEN size > 52428800 THEN 'too_large'
        WHEN m <> '%PDF-' THEN 'not_a_pdf' WHEN pages IS NULL THEN 'unreadable' WHEN pages < 1 THEN 'no_pages' END AS reject_reason FROM u"""
)
def validate_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    up = _t(spark, sf_dir, "pages").select(
        k,
        F.when(k % 5 == 0, F.concat(F.lit("C:\\in\\doc"), k, F.lit(".txt"))).otherwise(F.concat(F.lit("in/doc"), k, F.lit(".PDF"))).alias("filename"),
        F.when(k % 7 == 1, "text/html").otherwise("application/pdf").alias("content_type"),
        F.when(k % 11 == 2, 0).otherwise(F.octet_length("html") * 9000).alias("size"),
        F.when(k % 13 == 3, "<html").otherwise("%PDF-").alias("magic"),
        F.when(k % 17 != 4, k % 19).alias("page_count"),
    )
    return catalog.validate_uploads(up).select("page_id", "filename", "reject_reason")


@query("SELECT doc_id AS document_id, count(*) AS pages FROM (SELECT doc_id, unnest(range(0, 1 + n_chars % 5)) FROM documents) GROUP BY doc_id")
def page_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), (1 + F.col("n_chars") % 5).alias("page_count"))
    return files.fan_out_pages(docs).groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"))


@query(
    "SELECT c_custkey AS document_id, coalesce(n, c_nationkey) AS page_count, n IS NOT NULL AND n <> c_nationkey AS changed FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey"
)
def page_count_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("document_id", F.col("c_nationkey").cast("long").alias("page_count"))
    counted = _jobs(spark, sf_dir).groupBy("document_id").agg(F.count(F.lit(1)).alias("page_count"))
    return catalog.page_count_repair(docs, counted).select("document_id", "page_count", "changed")


@query(
    """SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 3 = 0 THEN 'done' ELSE o_orderstatus END AS status,
    CASE WHEN o_orderkey % 3 = 0 THEN 0.5 ELSE o_totalprice END AS avg_confidence FROM orders"""
)
def set_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _jobs(spark, sf_dir)
    updates = jobs.filter("job_id % 3 = 0").select("job_id", F.lit("done").alias("status"), F.lit(0.5).alias("avg_confidence"))
    return catalog.set_status(jobs, updates).select("job_id", "status", "avg_confidence")


@query("SELECT status, count(*) AS n FROM (SELECT o_orderstatus AS status FROM orders UNION ALL SELECT 'queued' FROM orders WHERE o_orderstatus = 'F') GROUP BY status")
def reprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _jobs(spark, sf_dir).withColumn("job_id", F.col("job_id").cast("string"))
    again = catalog.reprocess(jobs, jobs.filter("status = 'F'"), F.lit(None).cast("timestamp_ntz"))
    return again.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"
)
def job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.job_states(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


SEARCHED = "the with that"
_TERMS = r"t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents)"


def _searchable(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = _t(spark, sf_dir, "documents")
    pages = docs.select(F.col("doc_id").alias("job_id"), F.lit(1).alias("page_number"), F.col("text").alias("search_text"))
    jobs = docs.select(F.col("doc_id").alias("job_id"), F.col("doc_id").alias("document_id"))
    return search.with_terms(pages), jobs, docs.select(F.col("doc_id").alias("document_id"), F.col("source").alias("filename"))


@query(
    f"""WITH {_TERMS}, u AS (SELECT doc_id, len(w) AS n, unnest(w) AS x FROM t),
    h AS (SELECT doc_id, n, count(*) AS k, count(DISTINCT x) AS d FROM u WHERE x IN ('the', 'with', 'that') GROUP BY ALL),
    r AS (SELECT doc_id, k / (1.0 + ln(1.0 + n)) AS rank FROM h WHERE d = 3 ORDER BY rank DESC, doc_id LIMIT 20)
    SELECT doc_id AS document_id, source AS filename, round(rank, 6) AS rank FROM r JOIN documents USING (doc_id)"""
)
def fts_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.search(*_searchable(spark, sf_dir), SEARCHED, 20)
    return out.select("document_id", "filename", F.round("rank", 6).alias("rank"))


_HIT = r"(?i)(^|[^\p{L}\p{N}_\x{01}])(the|with|that)([^\p{L}\p{N}_]|$)"
_MARKED = rf"regexp_replace(%s, '{_HIT}', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g')"


@query(
    rf"""WITH {_TERMS}, u AS (SELECT doc_id, len(w) AS n, unnest(w) AS x FROM t),
    h AS (SELECT doc_id, n, count(*) AS k, count(DISTINCT x) AS d FROM u WHERE x IN ('the', 'with', 'that') GROUP BY ALL),
    r AS (SELECT doc_id, k / (1.0 + ln(1.0 + n)) AS rank FROM h WHERE d = 3 ORDER BY rank DESC, doc_id LIMIT 100),
    s AS (SELECT r.doc_id, r.rank, source, list_filter(regexp_split_to_array(translate(text, chr(1) || chr(2), ''), '[ \t\n\x{{0B}}\f\r]+'), lambda x: x <> '') AS parts
      FROM r JOIN documents USING (doc_id)),
    f AS (SELECT *, list_position(list_transform(parts, lambda x: regexp_matches(x, '{_HIT}')), true) AS first FROM s),
    p AS (SELECT *, array_to_string(parts[greatest(1, first - 10):greatest(1, first - 10) + 34], ' ') AS piece FROM f)
    SELECT doc_id AS document_id, source AS filename, doc_id AS job_id, 1 AS page_number, {_MARKED % (_MARKED % "piece")} AS snippet, round(rank, 6) AS rank FROM p"""
)
def fts_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(*_searchable(spark, sf_dir), SEARCHED, 100).withColumn("rank", F.round("rank", 6))


@query(ORACLES["fts_search"])
def fts_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search by a stored inverted index."""
    pages, jobs, docs = _searchable(spark, sf_dir)
    path = f"{shared_dir(spark)}/pagewright/index-{uuid.uuid4().hex[:12]}"
    search.write_index(pages, path)
    out = search.search(pages.drop("terms"), jobs, docs, SEARCHED, 20, search.read_index(spark, path))
    return out.select("document_id", "filename", F.round("rank", 6).alias("rank"))


@query(
    f"""WITH {_TERMS}, u AS (SELECT doc_id, unnest(w) AS x FROM t)
    SELECT doc_id AS job_id, count(*) AS hits FROM u WHERE x IN ('the', 'with', 'that') GROUP BY doc_id HAVING count(DISTINCT x) = 3"""
)
def fts_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, _, _ = _searchable(spark, sf_dir)
    return search.match_postings(search.postings(pages, "job_id"), search.query_terms(SEARCHED), "job_id")


# --- accuracy, rasterising, state -----------------------------------------------------------------------------


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    v5 = part.select(F.col("p_type").alias("language"), F.lit("v5").alias("model"), F.replace("p_name", F.lit("e"), F.lit("")).alias("prediction"), F.col("p_name").alias("truth"))
    return v5.unionByName(v5.withColumn("model", F.lit("stock")).withColumn("prediction", F.lit("widget")))


@query(
    """WITH s AS (SELECT p_type AS language, 'v5' AS model, replace(p_name, 'e', '') AS p, p_name AS t FROM part UNION ALL SELECT p_type, 'stock', 'widget', p_name FROM part)
    SELECT language, model, CAST(count(*) AS INTEGER) AS n_samples, round(avg(levenshtein(p, t) / length(t)), 9) AS avg_cer FROM s GROUP BY ALL"""
)
def cer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir).withColumn("cer", metrics.cer(F.col("prediction"), F.col("truth"))).withColumn("wer", F.lit(0.0))
    return metrics.summary(rows).select("language", "model", "n_samples", F.round("avg_cer", 9).alias("avg_cer"))


@query(
    """WITH s AS (SELECT p_type AS language, 'v5' AS model, replace(p_name, 'e', '') AS p, p_name AS t FROM part UNION ALL SELECT p_type, 'stock', 'widget', p_name FROM part),
    w AS (SELECT *, list_filter(string_split(p, ' '), lambda x: x <> '') AS pw, list_filter(string_split(t, ' '), lambda x: x <> '') AS tw FROM s),
    c AS (SELECT *, list_distinct(list_concat(pw, tw)) AS d FROM w),
    e AS (SELECT *, array_to_string(list_transform(pw, lambda x: chr(CAST(64 + list_position(d, x) AS INTEGER))), '') AS pc,
      array_to_string(list_transform(tw, lambda x: chr(CAST(64 + list_position(d, x) AS INTEGER))), '') AS tc FROM c)
    SELECT language, model, CAST(count(*) AS INTEGER) AS n_samples, round(avg(levenshtein(p, t) / length(t)), 9) AS avg_cer,
      round(avg(levenshtein(pc, tc) / length(tc)), 9) AS avg_wer FROM e GROUP BY ALL"""
)
def wer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every word of a sample is a letter to SQL, so its distance of letters is one of words.
    found = metrics.summary(metrics.compare(_samples(spark, sf_dir)))
    return _rounded(found, "avg_cer", "avg_wer")


@query(
    """WITH p AS (SELECT p_partkey, 300.0 + 20 * p_size AS w, 400.0 + 13 * p_size AS h FROM part), z AS (SELECT *, least(200 / 72.0, 2200 / greatest(w, h)) AS zoom FROM p)
    SELECT p_partkey, round(CAST(zoom AS DOUBLE), 9) AS zoom, CAST(round(CAST(w AS DOUBLE) * zoom) AS INTEGER) AS page_width, CAST(round(CAST(h AS DOUBLE) * zoom) AS INTEGER) AS page_height FROM z"""
)
def raster_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _t(spark, sf_dir, "part").select(
        "p_partkey", (F.lit(300.0) + 20 * F.col("p_size")).alias("width_pt"), (F.lit(400.0) + 13 * F.col("p_size")).alias("height_pt")
    )
    return seams.raster_plan(pages).select("p_partkey", F.round("zoom", 9).alias("zoom"), "page_width", "page_height")


@query(
    """SELECT p_partkey, CASE WHEN abs(f) < 0.5 THEN 0.0 ELSE f END AS angle FROM (SELECT p_partkey, CASE WHEN a < -45 THEN a + 90 WHEN a > 45 THEN a - 90 ELSE a END AS f
    FROM (SELECT p_partkey, CAST(p_partkey % 181 - 90 AS DOUBLE) + 0.25 AS a FROM part))"""
)
def upright_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = (F.col("p_partkey") % 181 - 90).cast("double") + 0.25
    return _t(spark, sf_dir, "part").select("p_partkey", G.upright_angle(a).alias("angle"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    g(user_id, n, event_id, skipped, until) AS (
      SELECT user_id, n, event_id, false, CASE WHEN bad THEN t + 1800000000 ELSE 0 END FROM e WHERE n = 1
      UNION ALL SELECT e.user_id, e.n, e.event_id, e.t < g.until, CASE WHEN e.bad AND e.t >= g.until THEN e.t + 1800000000 ELSE g.until END
      FROM g JOIN e ON e.user_id = g.user_id AND e.n = g.n + 1)
    SELECT event_id, skipped FROM g"""
)
def breaker_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = state.breaker_batch(_t(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error")
    return out.select("event_id", "skipped")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    g(user_id, n, event_id, start, t) AS (SELECT user_id, n, event_id, t, t FROM e WHERE n = 1 UNION ALL
      SELECT e.user_id, e.n, e.event_id, greatest(e.t, g.start + 12000000), e.t FROM g JOIN e ON e.user_id = g.user_id AND e.n = g.n + 1)
    SELECT event_id, start AS start_us, start - t AS wait_us FROM g"""
)
def rate_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = state.spaced_calls(_t(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", Settings().requests_per_minute)
    return out.select("event_id", "start_us", "wait_us")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


from . import queries_io  # noqa: E402, F401 - registers its queries
