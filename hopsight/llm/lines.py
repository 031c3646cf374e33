"""Line dedup by a log-template tree of fixed depth.

A line goes down the tree by its number of tokens and its leading tokens; tokens with a digit are variable
fields. In a leaf a token is fixed if it stands at its place in enough documents, and a variable field
otherwise, so several templates of one leaf are told apart by their fixed tokens. A template must keep fixed
tokens at half of its places at least; lines with fewer are compared by their exact words. A template found in enough
documents recurs: its lines are dropped wherever they stand but for the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, read

DEPTH, MIN_DOCS = 3, 10
FIELD = "<*>"
_SPACE = r"[\x20\x09-\x0D]+"
#: Leaves and templates that are broadcast at most; of more, those with over one in HOT_SHARE lines are, and the others are joined by a shuffle.
BROADCAST_ROWS, HOT_SHARE = 200_000, 1000


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _words(line: Column) -> Column:
    return F.filter(F.split(line, _SPACE), lambda t: t != "")


def _tokens(line: Column) -> Column:
    """The words of a line, those with a digit as FIELD; most lines have none and are not looked through word by word."""
    masked = F.transform(_words(line), lambda t: F.when(t.rlike("[0-9]"), FIELD).otherwise(t))
    return F.when(line.rlike("[0-9]"), masked).otherwise(_words(line))


def _lines(keyed: DataFrame, depth: int) -> DataFrame:
    """(row_key, doc_id, line_no, leaf, m, x): hashes of the leaf, the tokens and the exact words."""
    line, fields = F.col("line"), F.size("t") - F.size(F.array_remove("t", FIELD))
    rows = (keyed.select("row_key", "doc_id", F.posexplode(_split(F.col("text"))).alias("line_no", "line"))
            .select("row_key", "doc_id", "line_no", "line", _tokens(line).alias("t"))
            .select("row_key", "doc_id", "line_no", "t", F.size("t").alias("n"), F.xxhash64("t").alias("h"),
                    F.when(line.rlike("[0-9]"), F.struct(F.xxhash64(_words(line)).alias("x"), (fields * 2 > F.size("t")).alias("loose"))).alias("f")))
    loose, x = F.coalesce(F.col("f.loose"), F.lit(False)), F.coalesce("f.x", "h")
    leaf = F.when(loose, F.xxhash64(F.lit("exact"), x)).otherwise(F.xxhash64("n", F.slice("t", 1, depth)))
    return rows.select("row_key", "doc_id", "line_no", F.when(F.col("n") > 0, leaf).alias("leaf"), F.when(loose, x).otherwise(F.col("h")).alias("m"), x.alias("x"))


def _joined(rows: DataFrame, small: DataFrame, on: list[str], weight: str) -> DataFrame:
    """rows join small, which has a row a key and the number of rows it meets as `weight`; no task gets a frequent key whole."""
    n, total = small.agg(F.count("*"), F.sum(weight)).first()
    side = small.drop(weight)
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(side), on)
    often = F.col(weight) > total // HOT_SHARE
    hot = F.broadcast(small.filter(often).drop(weight))
    return rows.join(hot, on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(small.filter(~often).drop(weight), on))


def _templates(keyed: DataFrame, lines: DataFrame, min_docs: int) -> DataFrame:
    """(leaf, m, template, rows): the template of every shape in leaves of enough documents; null if it keeps too few fixed tokens."""
    shapes = lines.groupBy("leaf", "m", "row_key").agg(F.count("*").alias("rows"), F.min("line_no").alias("line_no")).groupBy("leaf", "m").agg(
        F.count("*").alias("docs"), F.sum("rows").alias("rows"), F.min(F.struct("row_key", "line_no")).alias("at"))
    leaves = shapes.groupBy("leaf").agg(F.sum("docs").alias("all")).filter(F.col("all") >= min_docs)
    shapes = cut(shapes.join(leaves.select("leaf"), "leaf"))
    # tokens are not kept for all lines: those of a shape are read again from one of its documents
    at = shapes.select(F.col("at.row_key").alias("row_key"), F.col("at.line_no").alias("line_no"), "leaf", "m", "docs")
    at = F.broadcast(at) if at.count() <= BROADCAST_ROWS else at
    line = F.get(_split(F.col("text")), F.col("line_no"))
    tokens = cut(keyed.select("row_key", "text").join(at, "row_key").select("leaf", "m", "docs", line.alias("line"))
                 .dropDuplicates(["leaf", "m"]).select("leaf", "m", "docs", _tokens(F.col("line")).alias("t")))
    places = tokens.select("leaf", "m", "docs", F.posexplode("t").alias("at", "token")).filter(F.col("token") != FIELD)
    fixed = places.groupBy("leaf", "at", F.xxhash64("token").alias("token")).agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    kept = (places.select("leaf", "m", "at", F.xxhash64("token").alias("token")).join(fixed.drop("docs"), ["leaf", "at", "token"])
            .groupBy("leaf", "m").agg(F.count("*").alias("n_fixed"), F.xxhash64(F.sort_array(F.collect_list(F.struct("at", "token")))).alias("template")))
    template = F.when(F.col("n_fixed") * 2 >= F.size("t"), F.col("template"))
    return tokens.select("leaf", "m", "t").join(kept, ["leaf", "m"], "left").select("leaf", "m", template.alias("template")).join(
        shapes.select("leaf", "m", "rows"), ["leaf", "m"])


def marked(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """(row_key, flags): for every document that has a line to drop, whether each line is dropped."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("row_key"))
    lines = cut(_lines(keyed, depth).select("row_key", "doc_id", "line_no", "leaf", "m", "x"))
    # nothing recurs in a leaf of fewer lines; most lines of prose leave here
    often = lines.filter("leaf IS NOT NULL").groupBy("leaf").agg(F.count("*").alias("rows")).filter(F.col("rows") >= min_docs)
    some = cut(_joined(lines, cut(often), ["leaf"], "rows"))
    found = cut(_templates(keyed, some, min_docs))
    # the exact words stand for shapes without a template
    general = _joined(some, found.filter("template IS NOT NULL"), ["leaf", "m"], "rows").select(
        F.xxhash64("leaf", "template").alias("template"), "row_key", "doc_id", "line_no")
    exact = some.join(F.broadcast(found.filter("template IS NOT NULL").select("leaf", "m")) if found.count() <= BROADCAST_ROWS
                      else found.filter("template IS NOT NULL").select("leaf", "m"), ["leaf", "m"], "left_anti").select(
        F.xxhash64(F.lit("words"), "x").alias("template"), "row_key", "doc_id", "line_no")
    placed = cut(general.unionByName(exact))
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("row_key").alias("c"), F.col("line_no").alias("d"))
    recurring = (placed.groupBy("template", "row_key").agg(F.min(order).alias("first"), F.count("*").alias("rows")).groupBy("template")
                 .agg(F.count("*").alias("docs"), F.min("first").alias("first"), F.sum("rows").alias("rows")).filter(F.col("docs") >= min_docs))
    recurring = cut(recurring.select("template", F.col("first.c").alias("first_row"), F.col("first.d").alias("first_line"), "rows"))
    dropped = (_joined(placed, recurring, ["template"], "rows")
               .filter((F.col("row_key") != F.col("first_row")) | (F.col("line_no") != F.col("first_line")))
               .select("row_key", "line_no").distinct())
    dropped = cut(dropped)
    touched = dropped.select("row_key").distinct()
    flags = (lines.select("row_key", "line_no").join(touched, "row_key").join(dropped.withColumn("drop", F.lit(True)), ["row_key", "line_no"], "left")
             .groupBy("row_key").agg(F.sort_array(F.collect_set(F.struct("line_no", F.coalesce("drop", F.lit(False)).alias("drop")))).alias("f")))
    return flags.select("row_key", F.col("f.drop").alias("flags"))


def dedup(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of `docs` (doc_id, text) with their recurring lines dropped from `text`, and _lines and _dropped, the numbers of lines.

    The first line of a recurring template, by doc_id (null last) and line number, stays. Lines end at
    \\n; blank lines stay as they are. Lines of numbers and other lines without fixed tokens at half of their places recur
    only word for word. A variable field whose values each stand in `min_docs` documents counts as fixed. A null text stays
    null and has no line that counts. Rows that repeat are one document and come out alike; rows that share a doc_id but not
    the text are several. An empty table gives no rows; other columns are kept whatever their names, but for _lines and
    _dropped, which are replaced.
    """
    flags = marked(docs, depth, min_docs)
    others = [c for c in docs.columns if c not in ("_lines", "_dropped")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("r"), F.xxhash64("doc_id", "text").alias("row_key"))
    old, f = F.col("r.text"), F.col("flags")
    kept = F.filter(_split(old), lambda x, i: ~F.get(f, i))
    text = F.when(f.isNull(), old).otherwise(F.array_join(kept, "\n"))
    lines = F.when(old.isNull(), 0).otherwise(F.size(_split(old))).cast("long")
    gone = F.coalesce(F.size(F.filter(f, lambda x: x)), F.lit(0)).cast("long")
    return rows.join(flags, "row_key", "left").select(
        *[text.alias("text") if c == "text" else F.col("r").getField(c).alias(c) for c in others], lines.alias("_lines"),
        F.when(f.isNull(), 0).otherwise(gone).cast("long").alias("_dropped"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


SQL = rf"""
WITH l AS (SELECT doc_id, i line_no, string_split(text, chr(10))[i + 1] line
    FROM documents, LATERAL (SELECT unnest(range(len(string_split(text, chr(10))))) i) WHERE text IS NOT NULL),
w AS (SELECT doc_id, line_no, line, list_filter(string_split_regex(line, '{_SPACE}'), lambda x: x <> '') w FROM l),
t AS MATERIALIZED (SELECT *, len(w) n, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{FIELD}' ELSE x END) t FROM w WHERE len(w) > 0),
g AS (SELECT *, t[1:{DEPTH}] head FROM t WHERE len(list_filter(t, lambda x: x = '{FIELD}')) * 2 <= n),
k AS (SELECT n, head, i, token FROM (SELECT DISTINCT n, head, t, doc_id, unnest(range(n)) i, unnest(t) token FROM g) GROUP BY n, head, i, token
    HAVING count(*) >= {MIN_DOCS} AND token <> '{FIELD}'),
v AS (SELECT doc_id, line_no, n, head, list((i, token) ORDER BY i) f FROM (SELECT doc_id, line_no, n, head, unnest(range(n)) i, unnest(t) token FROM g)
    JOIN k USING (n, head, i, token) GROUP BY doc_id, line_no, n, head),
p AS (SELECT t.doc_id, t.line_no, CASE WHEN len(v.f) * 2 >= t.n THEN CAST((t.n, v.head, v.f) AS VARCHAR) ELSE 'words ' || array_to_string(t.w, ' ') END template
    FROM t LEFT JOIN v USING (doc_id, line_no)),
r AS (SELECT template, min((doc_id, line_no)) f FROM p GROUP BY template HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
d AS (SELECT doc_id, line_no FROM p JOIN r USING (template) WHERE (doc_id, line_no) <> f)
SELECT doc_id, CAST(count(line_no) AS BIGINT) n_lines, count(*) FILTER (gone) n_dropped,
  CASE WHEN any_value(txt) IS NULL THEN NULL ELSE sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) END kept_sha256
FROM (SELECT x.doc_id, x.text txt, l.line_no, l.line, d.doc_id IS NOT NULL gone FROM documents x LEFT JOIN l ON x.doc_id = l.doc_id
      LEFT JOIN d ON l.doc_id = d.doc_id AND l.line_no = d.line_no) GROUP BY doc_id
"""
