"""The findings algebra over the supplied tables: selection, suppression, baselines, order, summaries, edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.versions import at_least_version
from ..operators import edits, findings, paths, sequences
from .text_checks import lines, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


#: Events as findings: their type is the code, with a severity.
_SEVERITY = "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' WHEN 'signup' THEN 'warning' WHEN 'click' THEN 'note' ELSE 'none' END"
_RANK = "CASE {} WHEN 'none' THEN 0 WHEN 'note' THEN 1 WHEN 'warning' THEN 2 WHEN 'error' THEN 3 END"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("severity", F.expr(_SEVERITY))


@query("SELECT DISTINCT page_id, path FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1) AS path FROM pages) WHERE len(list_filter(string_split(path, '/')[:-2], lambda d: regexp_matches(d, '^[._]') OR d = 'vendor' OR d = 'fr')) = 0 AND path <> ''")
def discover_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths outside skipped directories (and ``fr``, as the tables have no hidden ones), distinct."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/?#]*/?([^?#]*)", 1).alias("path")).where("path <> ''")
    return rows.where(~paths.in_skipped_directory(F.col("path")) & ~paths.excluded(F.col("path"), ["fr"])).distinct()


@query("SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '^([^/]+/)*[^/]*\\.html$') AND NOT (url = 'https:/x' OR starts_with(url, 'https:/x/'))")
def glob_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages left by a glob and a directory exclusion."""
    return table(spark, sf_dir, "pages").where(~paths.excluded(F.col("url"), ["**/*.html", "https:/x"])).select("page_id", "url")


@query(f"SELECT event_id, severity FROM (SELECT event_id, {_SEVERITY} AS severity FROM events) WHERE {_RANK.format('severity')} >= 2")
def severity_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.at_least(_events(spark, sf_dir), "warning").select("event_id", "severity")


_SETTINGS = "(VALUES ('FRANCE', 4), ('CHINA', 9), ('NOWHERE', 1)) AS s(name, set_limit)"


@query(f"SELECT n_name, CAST(coalesce(set_limit, 8) AS INTEGER) AS value FROM nation LEFT JOIN {_SETTINGS} ON n_name = name")
def option_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option values: the setting's, else the default."""
    settings = spark.sql(f"SELECT * FROM {_SETTINGS}")
    nation = table(spark, sf_dir, "nation")
    return nation.join(F.broadcast(settings), nation.n_name == settings.name, "left").select("n_name", F.coalesce("set_limit", F.lit(8)).alias("value"))


@query("SELECT l_orderkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey) AS nth FROM lineitem) WHERE nth > 1")
def duplicated_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second and later occurrences of a key."""
    return sequences.repeats(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey"], ["l_linenumber", "l_partkey"]).select("l_orderkey", "l_suppkey", "l_linenumber")


@query("SELECT event_id, user_id, event_type, first_type FROM (SELECT *, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_type FROM events) WHERE event_type <> first_type")
def first_wins_inconsistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose type differs from their user's first."""
    return sequences.unlike_first(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", "first_type").select("event_id", "user_id", "event_type", "first_type")


_WORDS = "SELECT doc_id, w, p FROM (SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w, generate_subscripts(string_split(replace(text, chr(10), ' '), ' '), 1) AS p FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(w, '^[A-Za-z]+$')"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.posexplode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ", -1)).alias("p", "w")).where(F.col("w").rlike("^[A-Za-z]+$"))


@query(f"SELECT doc_id, CAST(p AS INTEGER) AS pos, w, first_spelling FROM (SELECT *, first_value(w) OVER (PARTITION BY doc_id, lower(w) ORDER BY p) AS first_spelling FROM ({_WORDS})) WHERE w <> first_spelling")
def case_fold_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words spelt unlike their first spelling in the document, but for case."""
    rows = _words(spark, sf_dir).withColumn("low", F.lower("w"))
    return sequences.unlike_first(rows, ["doc_id", "low"], ["p"], "w", "first_spelling").select("doc_id", (F.col("p") + 1).alias("pos"), "w", "first_spelling")


_TYPE_RANK = "CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END"


@query(f"SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM (SELECT *, max({_TYPE_RANK}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM events) WHERE {_TYPE_RANK} < top) WHERE nth = 1")
def declaration_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user whose rank drops below the highest so far."""
    return sequences.first_drop(_events(spark, sf_dir).withColumn("rank", F.expr(_TYPE_RANK)), ["user_id"], ["ts", "event_id"], "rank").select("user_id", "event_id")


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS before FROM lineitem) WHERE before = l_returnflag")
def adjacent_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the same flag as the line before."""
    return sequences.like_previous(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_returnflag").select("l_orderkey", "l_linenumber")


@query("SELECT page_id, url FROM pages WHERE regexp_matches(lower(url), '^(http|ws|ftp)://')")
def insecure_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(F.lower("url").rlike("^(http|ws|ftp)://")).select("page_id", "url")


@query("SELECT doc_id, string_split(text, chr(10))[1] AS first_line FROM documents WHERE NOT regexp_matches(trim(string_split(text, chr(10))[1]), '[.!?:]$')")
def doc_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines that do not end a sentence."""
    first = F.substring_index("text", "\n", 1)
    return table(spark, sf_dir, "documents").where(~F.trim(first).rlike("[.!?:]$")).select("doc_id", first.alias("first_line"))


_MARKED = "(VALUES (-1, 'x TODO: later'), (-2, 'FIXMEs'), (-3, 'a BUG here, TODO'), (-4, 'todo')) AS t(doc_id, text)"


@query(f"SELECT doc_id, list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda w: w IN ('TODO', 'FIXME', 'BUG'))[1] AS marker FROM (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM {_MARKED}) WHERE len(list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda w: w IN ('TODO', 'FIXME', 'BUG'))) > 0")
def task_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with an exact marker word, with their first."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.sql(f"SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM {_MARKED}"))
    found = F.filter(F.split("text", "[^A-Za-z]+", -1), lambda w: w.isin("TODO", "FIXME", "BUG"))
    return rows.where(F.size(found) > 0).select("doc_id", found[0].alias("marker"))


_BIDI = "(VALUES (-1, 'a' || chr(8238) || 'b' || chr(8297)), (-2, 'plain')) AS t(doc_id, text)"
_BIDI_SPARK = "(VALUES (-1L, 'a\\u202Eb\\u2069'), (-2L, 'plain')) AS t(doc_id, text)"
_BIDI_CLASS = "[" + "".join(map(chr, [*range(0x202A, 0x202F), *range(0x2066, 0x206A)])) + "]"


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{_BIDI_CLASS}')) AS INTEGER) AS n FROM (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM {_BIDI}) WHERE regexp_matches(text, '{_BIDI_CLASS}')")
def bidi_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with bidirectional control characters, counted."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.sql(f"SELECT * FROM {_BIDI_SPARK}"))
    return rows.where(F.col("text").rlike(_BIDI_CLASS)).select("doc_id", F.regexp_count("text", F.lit(_BIDI_CLASS)).alias("n"))


@query("SELECT l_orderkey, CAST(1 + sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) + sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS complexity FROM lineitem GROUP BY l_orderkey HAVING 1 + sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) + sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) > 5")
def complexity_by_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners whose branch count passes a limit."""
    n = 1 + F.count_if(F.col("l_returnflag") == "R") + F.count_if(F.col("l_quantity") > 25)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(n.alias("complexity")).where("complexity > 5")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 40)")
def unused_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return table(spark, sf_dir, "part").join(used, "p_partkey", "left_anti").select("p_partkey")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (1, 5, 9, 12)")
def blocklist_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = spark.sql("SELECT * FROM VALUES (1), (5), (9), (12) AS t(s_nationkey)")
    return table(spark, sf_dir, "supplier").join(F.broadcast(blocked), "s_nationkey", "left_semi").select("s_suppkey", "s_name")


_RANGES = "(VALUES ('O', DATE '1995-01-01', DATE '1995-06-30'), ('all', DATE '1996-03-01', DATE '1996-03-31'), ('F', DATE '1993-01-01', DATE '1994-12-31')) AS r(code, lo, hi)"


@query(f"SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM {_RANGES} WHERE (code = 'all' OR code = o_orderstatus) AND CAST(o_orderdate AS DATE) BETWEEN lo AND hi)")
def suppress_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders outside the suppressing ranges of their status or of all."""
    ranges = spark.sql(f"SELECT * FROM {_RANGES}")
    day = F.to_date("o_orderdate")
    inside = ((F.col("code") == "all") | (F.col("code") == F.col("o_orderstatus"))) & (day >= F.col("lo")) & (day <= F.col("hi"))
    return table(spark, sf_dir, "orders").join(F.broadcast(ranges), inside, "left_anti").select("o_orderkey")


@query("SELECT event_id, next_id FROM (SELECT event_id, event_type, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_id FROM events) WHERE event_type = 'error' AND next_id IS NOT NULL")
def next_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event that follows each error of a user, as a directive binds the next statement."""
    return sequences.following(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_id", "next_id").where("event_type = 'error' AND next_id IS NOT NULL").select("event_id", "next_id")


@query("SELECT event_id, view_id FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS view_id FROM events) WHERE event_type = 'purchase' AND view_id IS NOT NULL")
def nearest_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last view before each purchase of a user, as a comment belongs to what follows it."""
    view = F.when(F.col("event_type") == "view", F.col("event_id"))
    return sequences.last_before(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], view, "view_id").where("event_type = 'purchase' AND view_id IS NOT NULL").select("event_id", "view_id")


@query("SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events")
def finding_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").alias("day")).distinct()


_ITEMS = "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax, l_returnflag, l_linestatus, date_trunc('month', l_shipdate) AS month FROM lineitem"
_BASE = f"SELECT l_returnflag, l_linestatus, month FROM ({_ITEMS}) WHERE l_quantity < 25"
_KEY = ["l_returnflag", "l_linestatus", "month"]
_KEYS = ", ".join(_KEY)


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax", "l_returnflag", "l_linestatus", F.date_trunc("month", "l_shipdate").alias("month"))
    return rows, rows.where("l_quantity < 25").select(*_KEY)


@query(f"SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY l_orderkey, l_linenumber, l_partkey) AS nth FROM ({_ITEMS})) LEFT JOIN (SELECT {_KEYS}, count(*) AS recorded FROM ({_BASE}) GROUP BY ALL) USING ({_KEYS}) WHERE nth > coalesce(recorded, 0)")
def baseline_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bag difference of all lines against recorded ones, those of small quantities; the earliest rows are cancelled."""
    rows, base = _items(spark, sf_dir)
    return findings.baseline_apply(rows, base, _KEY, ["l_orderkey", "l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber")


@query(f"SELECT l_returnflag, l_linestatus, CAST(month AS DATE) AS month, want - coalesce(have, 0) AS stale FROM (SELECT {_KEYS}, count(*) AS want FROM ({_BASE}) GROUP BY ALL) LEFT JOIN (SELECT {_KEYS}, count(*) AS have FROM ({_ITEMS}) WHERE l_tax > 0.04 GROUP BY ALL) USING ({_KEYS}) WHERE want > coalesce(have, 0)")
def baseline_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded lines, those of small quantities, that the lines of high tax do not match."""
    rows, base = _items(spark, sf_dir)
    return findings.baseline_stale(rows.where("l_tax > 0.04"), base, _KEY).withColumn("month", F.to_date("month"))


@query("SELECT code, state, count(*) AS recorded FROM (SELECT event_type AS code, CASE WHEN event_type IN ('error', 'click') THEN 'compared' WHEN event_type IN ('view', 'signup') THEN 'matched' ELSE 'stale' END AS state FROM events) GROUP BY ALL")
def baseline_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded events: selected types are compared, known unselected ones stay matched, unknown ones are stale."""
    recorded = table(spark, sf_dir, "events").select(F.col("event_type").alias("code"))
    return findings.baseline_states(recorded, selected=["error", "click"], known=["error", "click", "view", "signup"]).groupBy("code", "state").agg(F.count(F.lit(1)).alias("recorded"))


@query(f"SELECT code, findings, CASE r WHEN 0 THEN 'none' WHEN 1 THEN 'note' WHEN 2 THEN 'warning' ELSE 'error' END AS severity, row_number() OVER (ORDER BY findings DESC, code) AS place FROM (SELECT event_type AS code, count(*) AS findings, max({_RANK.format('(' + _SEVERITY + ')')}) AS r FROM events GROUP BY event_type)")
def summary_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes by number of findings, with their place; the window runs over the few codes."""
    out = findings.summary_by_code(_events(spark, sf_dir).withColumn("code", F.col("event_type")))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("findings"), "code")))


@query(f"SELECT count(*) FILTER (WHERE s = 'error') AS errors, count(*) FILTER (WHERE s = 'warning') AS warnings, count(*) FILTER (WHERE s = 'note') AS notes FROM (SELECT {_SEVERITY} AS s FROM events)")
def summary_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("severity")
    return _events(spark, sf_dir).agg(F.count_if(s == "error").alias("errors"), F.count_if(s == "warning").alias("warnings"), F.count_if(s == "note").alias("notes"))


@query("SELECT event_type, count(*) AS n, CAST(100 * count(*) // CAST(sum(count(*)) OVER () AS BIGINT) AS BIGINT) AS percent FROM events GROUP BY event_type")
def percent_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncated percentages; the window runs over the few codes."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("percent", F.expr("(100 * n) div sum(n) OVER ()"))


@query("SELECT event_type, count(*) AS n, CAST(100 * count(*) // max(count(*)) OVER () AS BIGINT) AS percent FROM events GROUP BY event_type")
def percent_of_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("percent", F.expr("(100 * n) div max(n) OVER ()"))


@query("SELECT doc_id, lang, CAST(turn AS INTEGER) AS turn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, lang LIMIT 50")
def stratified_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents, in turn from each language."""
    return findings.stratified_limit(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["doc_id"], 50).select("doc_id", "lang", "turn")


_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL)"


@query(f"SELECT a.doc_id, CAST(a.line_no AS INTEGER) AS at_line, CAST(b.line_no AS INTEGER) AS line_no, b.line FROM {_LINES} a JOIN {_LINES} b ON a.doc_id = b.doc_id AND b.line_no BETWEEN a.line_no - 1 AND a.line_no + 1 WHERE contains(a.line, '@')")
def context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with an address and their neighbours; each document's lines meet as an equi join, the range is a filter."""
    text = lines(spark, sf_dir)
    at = text.where(F.contains("line", F.lit("@"))).select("doc_id", F.explode(F.expr("array(line_no - 1, line_no, line_no + 1)")).alias("line_no"), F.col("line_no").alias("at_line"))
    return at.join(text, ["doc_id", "line_no"]).select("doc_id", "at_line", "line_no", "line")


_SPANS = "SELECT l_orderkey AS file, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS id, min(CAST(l_partkey % 100 AS INTEGER)) AS lo, max(CAST(l_partkey % 100 + l_quantity AS INTEGER)) AS hi FROM lineitem GROUP BY 1, 2"


@query(f"SELECT DISTINCT file, id FROM (SELECT a.file, unnest([a.id, b.id]) AS id FROM ({_SPANS}) a JOIN ({_SPANS}) b ON a.file = b.file AND a.id < b.id AND a.lo < b.hi AND b.lo < a.hi)")
def edit_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that overlap another one of their file."""
    spans = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS file", "l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS id", "CAST(l_partkey % 100 AS INT) AS lo", "CAST(l_partkey % 100 + l_quantity AS INT) AS hi")
    spans = spans.groupBy("file", "id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return edits.conflicting(spans)


@query("SELECT doc_id, 'HEAD' || substr(text, 3, 5) || substr(text, 11) AS text FROM documents WHERE regexp_matches(text, '^[ -~\n]{20,}$')")
def apply_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edits spliced into each plain text, from the back."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike("^[ -~\n]{20,}$"))
    made = F.expr("array(named_struct('start', 0, 'end', 2, 'new_text', 'HEAD'), named_struct('start', 7, 'end', 10, 'new_text', ''))")
    return docs.select("doc_id", edits.applied(F.col("text"), made).alias("text"))


_EXPECTED = "(VALUES ('O', 1), ('F', 2), ('X', 3)) AS e(status, expected)"


@query(f"SELECT coalesce(status, o_orderstatus) AS status, (CASE WHEN expected IS NULL THEN 'new' WHEN n IS NULL THEN 'missing' WHEN expected IS NOT DISTINCT FROM n THEN 'same' ELSE 'changed' END) AS state FROM {_EXPECTED} FULL JOIN (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) ON status = o_orderstatus")
def regression_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded against observed counts, null-safe."""
    expected = spark.sql(f"SELECT * FROM {_EXPECTED}")
    seen = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    state = F.when(F.col("expected").isNull(), "new").when(F.col("n").isNull(), "missing").when(F.col("expected").eqNullSafe(F.col("n")), "same").otherwise("changed")
    return expected.join(seen, expected.status == seen.o_orderstatus, "full_outer").select(F.coalesce("status", "o_orderstatus").alias("status"), state.alias("state"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'removed' WHEN a.doc_id IS NULL THEN 'added' ELSE 'changed' END AS change FROM (SELECT doc_id, sha256(text) AS h FROM documents UNION ALL SELECT CAST(-1 AS BIGINT), sha256('gone')) a FULL JOIN (SELECT doc_id, sha256(CASE WHEN lang = 'de' THEN text || '!' ELSE text END) AS h FROM documents UNION ALL SELECT CAST(-2 AS BIGINT), sha256('new')) b USING (doc_id) WHERE a.h IS DISTINCT FROM b.h")
def changed_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of two generations by content hash: the table with a row more, and a copy with its German texts changed and another row."""
    from ..streaming.watch import generation_changes

    docs = table(spark, sf_dir, "documents")
    old = docs.select("doc_id", "text").unionByName(spark.sql("SELECT -1L AS doc_id, 'gone' AS text"))
    new = docs.select("doc_id", F.expr("CASE WHEN lang = 'de' THEN text || '!' ELSE text END").alias("text")).unionByName(spark.sql("SELECT -2L AS doc_id, 'new' AS text"))
    return generation_changes(old, new, "doc_id", "text")


@query("SELECT doc_id, source, row_number() OVER (ORDER BY source, lang DESC, n_chars, doc_id) AS place FROM documents ORDER BY source, lang DESC, n_chars, doc_id LIMIT 25")
def canonical_sort_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows in full key order; only they are numbered."""
    order = ["source", F.desc("lang"), "n_chars", "doc_id"]
    top = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").orderBy(*order).limit(25)
    return top.select("doc_id", "source", F.row_number().over(Window.orderBy(*order)).alias("place"))


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_CLASS = "CASE WHEN {h} LIKE '%.com' THEN 0 WHEN {h} LIKE '%.net' THEN 1 ELSE 2 END"


@query(f"SELECT page_id, category, row_number() OVER (PARTITION BY category ORDER BY url, page_id) AS place FROM (SELECT page_id, url, {_CLASS.format(h=_HOST)} AS category FROM pages)")
def import_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order within import categories; hosts' top-level domains stand for the categories."""
    rows = table(spark, sf_dir, "pages").withColumn("h", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)).withColumn("category", F.expr(_CLASS.format(h="h")))
    return rows.select("page_id", "category", F.row_number().over(Window.partitionBy("category").orderBy("url", "page_id")).alias("place"))


_VERSIONS = "(VALUES ('1.18', '1.9'), ('1.21', '1.21'), ('1.4.10', '1.4.9'), ('1.22', '1.22.3')) AS v(have, need)"


@query(f"SELECT have, need, list_transform(string_split(have, '.'), lambda x: CAST(x AS INTEGER)) >= list_transform(string_split(need, '.'), lambda x: CAST(x AS INTEGER)) AS ok FROM {_VERSIONS}")
def version_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {_VERSIONS}").select("have", "need", at_least_version(F.col("have"), F.col("need")).alias("ok"))


_NUMBERED = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events"


@query(f"SELECT user_id, CAST(min(pos) - 3 AS INTEGER) AS lo, CAST(max(pos) + 3 AS INTEGER) AS hi, count(*) AS changes FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY pos) AS island FROM (SELECT *, CASE WHEN pos - 3 > lag(pos) OVER (PARTITION BY user_id ORDER BY pos) + 3 + 1 THEN 1 ELSE 0 END AS fresh FROM (SELECT * FROM ({_NUMBERED}) WHERE event_type = 'error'))) GROUP BY user_id, island")
def gap_islands_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed positions padded by three and merged where they touch."""
    numbered = table(spark, sf_dir, "events").withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return sequences.islands(numbered.where("event_type = 'error'"), ["user_id"], "pos", 3)


@query("SELECT sha256(text) AS target, count(*) AS copies, count(DISTINCT lang) AS langs, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def group_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that several rows share, folded with the facts that must agree."""
    docs = table(spark, sf_dir, "documents").withColumn("target", F.sha2("text", 256))
    return docs.groupBy("target").agg(F.count(F.lit(1)).alias("copies"), F.count_distinct("lang").alias("langs"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query(f"SELECT lower(w) AS low, list_sort(list(DISTINCT w)) AS spellings FROM ({_WORDS}) GROUP BY 1 HAVING count(DISTINCT w) > 1")
def case_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).groupBy(F.lower("w").alias("low")).agg(F.array_sort(F.collect_set("w")).alias("spellings")).where(F.size("spellings") > 1)


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'without label' ELSE 'without document' END AS orphan FROM documents d FULL JOIN (SELECT doc_id FROM labels UNION ALL SELECT CAST(-1 AS BIGINT)) l USING (doc_id) WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def orphans_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label, and labels without a document (one is added)."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d_id"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id")).unionByName(spark.sql("SELECT -1L AS l_id"))
    both = d.join(labels, F.col("d_id") == F.col("l_id"), "full_outer")
    return both.where("d_id IS NULL OR l_id IS NULL").select(F.coalesce("d_id", "l_id").alias("doc_id"), F.when(F.col("l_id").isNull(), "without label").otherwise("without document").alias("orphan"))


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))")
def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by two dimensions in one pass."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupingSets([[orders.o_orderstatus], [orders.o_orderpriority]], orders.o_orderstatus, orders.o_orderpriority).agg(F.count(F.lit(1)).alias("n")).select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "n")


def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line diffs of each document against the next of its source; rows only, as SQL has no shortest edit script."""
    from ..operators.diff import diffed

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    pairs = docs.withColumn("after", F.lead("text").over(Window.partitionBy("source").orderBy("doc_id"))).where("after IS NOT NULL")
    return diffed(pairs.select("doc_id", F.col("text").alias("before"), "after")).select("doc_id", "removed", "added", "hunks")


QUERIES["line_diff"] = line_diff
