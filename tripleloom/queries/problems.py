"""Queries of the general data problems over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import RDF_TYPE, XSD
from ..operators import changes, hierarchy, history, skew, widen
from ..runtime import new_path
from ..sources import lines

# The predicates that state hierarchies.
PARENT, CHILD, SUBCLASS = "<https://schema.org/parentOrganization>", "<https://schema.org/subOrganization>", "<http://www.w3.org/2000/01/rdf-schema#subclassOf>"
PERSON = "<http://xmlns.com/foaf/0.1/Person>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- 1

def p1_found(spark: SparkSession, d: str) -> DataFrame:
    store = history.ChainStore(spark, new_path(spark, "history"))
    return history.corrected(store, table(spark, d, "graph_snapshots"), table(spark, d, "snapshot_log")).select("s", "p", "o", "valid_from", "valid_to")


def p1_current(spark: SparkSession, d: str) -> DataFrame:
    return p1_found(spark, d).where(F.col("valid_to") == history.OPEN).select("s", "p", "o", "valid_from")


_NORMAL = """CASE WHEN o LIKE '"%"^^<http://www.w3.org/2001/XMLSchema#string>' THEN left(o, length(o) - 43) ELSE o END"""
P1_SQL = f"""
WITH shown AS (SELECT DISTINCT graph_name, s, p, {_NORMAL} AS o, version FROM graph_snapshots WHERE o IS NOT NULL),
gone AS (SELECT t.*, (SELECT min(l.version) FROM snapshot_log l WHERE l.complete AND l.graph_name = t.graph_name AND l.version > t.version) AS gone
         FROM (SELECT DISTINCT graph_name, version FROM shown) t),
seen AS (SELECT s.*, g.gone, lead(s.version) OVER w AS later, lag(g.gone) OVER w AS before, lag(s.version) OVER w AS earlier
         FROM shown s JOIN gone g USING (graph_name, version) WINDOW w AS (PARTITION BY graph_name, s, p, o ORDER BY s.version)),
runs AS (SELECT *, sum(CASE WHEN earlier IS NULL OR before < version THEN 1 ELSE 0 END) OVER (PARTITION BY graph_name, s, p, o ORDER BY version) AS run FROM seen)
SELECT s, p, o, min(version)::INT AS valid_from, coalesce(arg_max(coalesce(gone, -1), version), -1)::INT AS valid_to FROM runs GROUP BY graph_name, s, p, o, run"""
P1_CURRENT_SQL = f"SELECT s, p, o, valid_from FROM ({P1_SQL}) WHERE valid_to = -1"


# -- 2

def parent_links(spark: SparkSession, d: str) -> DataFrame:
    """(child, parent) of the stated hierarchies; one scan of three predicates."""
    t = table(spark, d, "triples").where(F.col("p").isin(PARENT, CHILD, SUBCLASS)).select("s", "p", "o")
    up = F.col("p") != CHILD
    return t.select(F.when(up, F.col("s")).otherwise(F.col("o")).alias("child"), F.when(up, F.col("o")).otherwise(F.col("s")).alias("parent"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(parent_links(spark, d)).select("node", "root", "depth")


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every (ancestor, descendant) pair with its distance."""
    return hierarchy.descendants(hierarchy.hierarchy(parent_links(spark, d)))


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.paths(hierarchy.hierarchy(parent_links(spark, d))).select("node", F.array_join("path", " / ").alias("path"))


_LINKS = f"""links AS (SELECT child, min(parent) AS parent FROM (
  SELECT CASE WHEN p = '{CHILD}' THEN o ELSE s END AS child, CASE WHEN p = '{CHILD}' THEN s ELSE o END AS parent
  FROM triples WHERE p IN ('{PARENT}', '{CHILD}', '{SUBCLASS}') AND s IS NOT NULL AND o IS NOT NULL) GROUP BY child),
nodes AS (SELECT child AS node FROM links UNION SELECT parent FROM links),
tree AS (SELECT node, node AS root, 0 AS depth, node AS path FROM nodes WHERE node NOT IN (SELECT child FROM links)
         UNION ALL SELECT l.child, t.root, t.depth + 1, t.path || ' / ' || l.child FROM tree t JOIN links l ON l.parent = t.node)"""
P2_SQL = f"WITH RECURSIVE {_LINKS} SELECT n.node, coalesce(t.root, '') AS root, coalesce(t.depth, -1)::INT AS depth FROM nodes n LEFT JOIN tree t ON t.node = n.node"
P2_PATHS_SQL = f"WITH RECURSIVE {_LINKS} SELECT node, path FROM tree"
P2_DESCENDANTS_SQL = f"""WITH RECURSIVE {_LINKS},
pairs AS (SELECT l.parent AS ancestor, l.child AS descendant, 1 AS distance FROM links l JOIN tree t ON t.node = l.child
          UNION ALL SELECT l.parent, p.descendant, p.distance + 1 FROM pairs p JOIN links l ON l.child = p.ancestor)
SELECT ancestor, descendant, distance::INT AS distance FROM pairs"""


# -- 3

def people_columns(spark: SparkSession, d: str) -> list[widen.Attribute]:
    """The columns to make; a list of the width of the wide table, read by the driver because it is the schema."""
    rows = table(spark, d, "attr_columns").where("p IS NOT NULL AND attr IS NOT NULL").select("p", "attr", "value_type").collect()
    return sorted((widen.Attribute(r.p, r.attr, r.value_type) for r in rows), key=lambda a: (a.column, a.predicate))


def people(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "triples").where((F.col("p") == RDF_TYPE) & (F.col("o") == PERSON))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    columns = people_columns(spark, d)
    wide = widen.pivot_blocks(table(spark, d, "triples").select("s", "p", "o"), people(spark, d), columns, block=5, typed=False)
    return widen.cells(wide, list(dict.fromkeys(a.column for a in columns)))


def p3_wide(spark: SparkSession, d: str) -> DataFrame:
    """Typed columns; ``beyond_types`` has as JSON what a column's type cannot hold."""
    wide = widen.pivot_blocks(table(spark, d, "triples").select("s", "p", "o"), people(spark, d), people_columns(spark, d), block=5, beyond="beyond_types")
    return wide.withColumn("beyond_types", F.to_json("beyond_types"))


P3_SQL = rf"""
WITH raw AS (
  SELECT t.s, a.attr, a.value_type AS kind, t.o,
    CASE WHEN t.o LIKE '"%' THEN replace(regexp_replace(regexp_replace(t.o, '(@[A-Za-z0-9-]+|\^\^<[^>]*>)$', ''), '^"(.*)"$', '\1', 's'), '\"', '"')
         WHEN t.o NOT LIKE '<%' AND t.o NOT LIKE '\_:%' ESCAPE '\' THEN t.o END AS lit
  FROM triples t JOIN attr_columns a ON a.p = t.p
  WHERE t.s IN (SELECT s FROM triples WHERE p = '{RDF_TYPE}' AND o = '{PERSON}')),
val AS (SELECT s, attr, kind, o, trim(lit, ' ') AS x FROM raw),
ok AS (
  SELECT s, attr, kind, CASE kind
    WHEN 'iri' THEN CASE WHEN o LIKE '<%>' AND o NOT LIKE '<<%' THEN o[2:-2] END
    WHEN 'string' THEN CASE WHEN x <> '' THEN x END
    WHEN 'int' THEN CASE WHEN regexp_full_match(x, '[+-]?[0-9]+') THEN CAST(CAST(x AS HUGEINT) AS VARCHAR) END
    WHEN 'decimal' THEN CASE WHEN regexp_full_match(x, '[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?') THEN CAST(TRY_CAST(TRY_CAST(x AS DECIMAL(38,10)) AS DECIMAL(38,2)) AS VARCHAR) END
    WHEN 'date' THEN CASE WHEN regexp_full_match(x, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(T.*)?', 's') AND TRY_CAST(left(x, 10) AS DATE) IS NOT NULL AND x NOT LIKE '0000%' THEN left(x, 10) END
    WHEN 'boolean' THEN CASE WHEN lower(x) IN ('true', '1') THEN 'true' WHEN lower(x) IN ('false', '0') THEN 'false' END
    WHEN 'year' THEN CASE WHEN regexp_full_match(x, '[0-9]{{4}}') THEN CAST(CAST(x AS INT) AS VARCHAR) END END AS val,
    CASE WHEN kind = 'decimal' THEN TRY_CAST(x AS DECIMAL(38,10)) WHEN kind = 'int' THEN TRY_CAST(TRY_CAST(x AS HUGEINT) AS DECIMAL(38,10)) ELSE 0 END AS number
  FROM val)
SELECT s, attr, arg_min(val, (number, val)) AS val FROM ok WHERE val IS NOT NULL GROUP BY s, attr"""
_WIDE = {"name": "VARCHAR", "title": "VARCHAR", "mbox": "VARCHAR", "email": "VARCHAR", "age": "DECIMAL(38,0)", "height": "DECIMAL(38,2)", "born": "DATE", "birth_year": "INT", "active": "BOOLEAN", "joined": "DATE"}
P3_WIDE_SQL = f"""SELECT e.s, {', '.join(f"CAST(max(val) FILTER (attr = '{c}') AS {t}) AS {c}" for c, t in _WIDE.items())}, '{{}}' AS beyond_types
FROM (SELECT DISTINCT s FROM triples WHERE p = '{RDF_TYPE}' AND o = '{PERSON}' AND s IS NOT NULL) e LEFT JOIN ({P3_SQL}) f ON f.s = e.s GROUP BY e.s"""


# -- 4

def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.rejects(table(spark, d, "file_lines"))


def p4_triples(spark: SparkSession, d: str) -> DataFrame:
    return lines.valid_triples(table(spark, d, "file_lines"))


# A line's tokens are found by one regular expression; each becomes a letter, and the letters of a statement are reduced
# like a small grammar.  Quoted triples are followed six levels deep.
_TOKEN = r'[ \t\r]+|#.*|<<|>>|<[^<>]*>|"(?:[^"\\]|\\.)*"(?:@[^ \t\r<>"#]*|\^\^<[^<>]*>)?|[^ \t\r<>"#]+'


def _six(letters: str, pattern: str, by: str) -> str:
    for _ in range(6):
        letters = f"regexp_replace({letters}, '{pattern}', '{by}', 'g')"
    return letters


def _full(x: str, pattern: str) -> str:
    return f"regexp_full_match({x}, '{pattern.replace(chr(39), chr(39) * 2)}', 's')"


_ZONE, _YEAR = "(?:Z|[+-](?:0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?", "-?(?:[1-9][0-9]{4,}|[0-9]{4})"
_BODY, _TYPE = r"""regexp_extract(x, '^"(.*)"', 1, 's')""", r"""regexp_extract(x, '"\^\^<([^<>]*)>$', 1)"""
_DAY = f"""'0' || (((TRY_CAST(regexp_extract({_BODY}, '^(-?[0-9]+)-', 1) AS BIGINT) % 400 + 400) % 400) + 400) || regexp_extract({_BODY}, '^-?[0-9]+(-[0-9]{{2}}-[0-9]{{2}})', 1)"""
_TYPED_OK = f"""CASE {_TYPE} WHEN '{XSD}integer' THEN {_full(_BODY, '[+-]?[0-9]+')} WHEN '{XSD}decimal' THEN {_full(_BODY, '[+-]?(?:[0-9]+(?:[.][0-9]*)?|[.][0-9]+)')}
 WHEN '{XSD}boolean' THEN {_full(_BODY, 'true|false|1|0')} WHEN '{XSD}gYear' THEN {_full(_BODY, _YEAR + _ZONE)}
 WHEN '{XSD}date' THEN {_full(_BODY, _YEAR + '-[0-9]{2}-[0-9]{2}' + _ZONE)} AND TRY_CAST({_DAY} AS DATE) IS NOT NULL ELSE true END"""
_LITERAL = _full("CASE WHEN x[-1] = '.' THEN left(x, length(x) - 1) ELSE x END", f'"{lines.ESCAPES}"(?:{lines.TAG}|\\^\\^<{lines.IRI_BODY}>)?')
_WORD, _DOTS = "rtrim(x, '.')", "repeat('.', length(x) - length(rtrim(x, '.')))"
_LETTER = f"""CASE WHEN x[1] IN (' ', chr(9), chr(13)) THEN ' ' WHEN x[1] = '#' THEN '#' WHEN x = '<<' THEN '(' WHEN x = '>>' THEN ')' WHEN x[1] = '<' THEN 't'
 WHEN x[1] = '"' THEN CASE WHEN x[-1] = '"' THEN 'S' WHEN x[-1] = '.' THEN 't.' ELSE 't' END
 ELSE CASE WHEN {_WORD} = '' THEN '' WHEN x[1] = '.' THEN 'V' ELSE 't' END || {_DOTS} END"""
_CLASS = f"""CASE WHEN x[1] IN (' ', chr(9), chr(13), '#') THEN '' WHEN x = '<<' THEN '(' WHEN x = '>>' THEN ')'
 WHEN x[1] = '<' THEN CASE WHEN {_full('x', f'<{lines.IRI_BODY}>')} THEN 'i' ELSE 'x' END
 WHEN x[1] = '"' THEN CASE WHEN {_LITERAL} AND {_TYPED_OK} THEN 'l' ELSE 'x' END || CASE WHEN x[-1] = '.' THEN '.' ELSE '' END
 ELSE CASE WHEN {_WORD} = '' THEN '' WHEN {_WORD} = 'a' THEN 'a' WHEN {_full(_WORD, lines.NUMBER)} THEN 'l' WHEN x[:2] = '_:' THEN CASE WHEN {_full(_WORD, lines.LABEL)} THEN 'b' ELSE 'x' END
   WHEN {_full(_WORD, lines.NAME)} THEN 'i' ELSE 'x' END || {_DOTS} END"""
_TRIMMED = "ltrim(coalesce(line, ''), ' ' || chr(9) || chr(13))"
P4_SQL = f"""
WITH said AS (SELECT line_id, filename, line FROM file_lines WHERE {_TRIMMED} <> '' AND {_TRIMMED}[1] <> '#'),
named AS (SELECT * FROM said WHERE (filename LIKE '%ttl' OR filename LIKE '%nt') AND NOT regexp_matches(line, '{lines.PREFIX_LINE}') AND NOT regexp_matches(line, '{lines.BASE_LINE}')),
listed AS (SELECT line_id, regexp_extract_all(line, '{_TOKEN}', 0, 's') AS xs FROM named),
cut AS (SELECT line_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM listed),
told AS (SELECT line_id, sum(length(x)) AS size, string_agg({_LETTER}, '' ORDER BY i) AS letters, string_agg({_CLASS}, '' ORDER BY i) AS classes FROM cut GROUP BY line_id)
SELECT line_id, 'file' AS reason FROM said WHERE filename IS NULL OR NOT (filename LIKE '%ttl' OR filename LIKE '%nt')
UNION ALL SELECT line_id, reason FROM (SELECT n.line_id, CASE
  WHEN size IS NULL OR size < length(n.line) OR regexp_matches(letters, 'S[^ #).V]') OR {_six("regexp_replace(letters, '[^()]', '', 'g')", '[(][)]', '')} <> '' THEN 'quoting'
  WHEN {_six("regexp_replace(regexp_replace(letters, '[ #]', '', 'g'), '[tSV]', 't', 'g')", '[(]ttt[)]', 't')} <> 'ttt.' THEN 'columns'
  WHEN NOT regexp_full_match({_six('classes', '[(][ibq][ia][iblq][)]', 'q')}, '[ibq][ia][iblq][.]') THEN 'value' END AS reason
  FROM named n LEFT JOIN told t USING (line_id)) WHERE reason IS NOT NULL"""


# -- 5

#: Batches that the feed is applied in, in order of arrival.
FEED_BATCHES = 3


def feed_batches(feed: DataFrame, batches: int = FEED_BATCHES) -> list[DataFrame]:
    """The feed cut into ranges of ``change_id``, which is the order of arrival."""
    least, most = feed.agg(F.min("change_id"), F.max("change_id")).first()
    if least is None:
        return [feed]
    step = (most - least) // batches + 1
    cuts = [(least + k * step, least + (k + 1) * step) for k in range(batches)]
    return [feed.where((F.col("change_id") >= F.lit(a)) & (F.col("change_id") < F.lit(b))) for a, b in cuts]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    store = changes.DeltaVectorTable(spark, new_path(spark, "changes"))
    for batch in feed_batches(table(spark, d, "triple_changes")):
        store.apply(batch)
    return store.read()


def p5_batches(spark: SparkSession, d: str) -> DataFrame:
    """The same state from two batches, the feed's later half first."""
    store = changes.DeltaVectorTable(spark, new_path(spark, "changes"))
    for batch in reversed(feed_batches(table(spark, d, "triple_changes"), 2)):
        store.apply(batch)
    return store.read()


P5_SQL = """
WITH known AS (SELECT *, (valid_from, coalesce(seq, -2147483648)) AS ord FROM triple_changes WHERE status IN (0, 1) AND valid_from IS NOT NULL AND s IS NOT NULL AND p IS NOT NULL),
begins AS (SELECT s, p, o, max(ord) AS b FROM known WHERE status = 0 AND o IS NOT NULL GROUP BY s, p, o),
ends AS (SELECT s, p, o, max(ord) AS e FROM (SELECT s, p, o, ord FROM known WHERE status = 1 AND o IS NOT NULL
         UNION ALL SELECT s, p, old_o, ord FROM known WHERE status = 0 AND old_o IS NOT NULL) GROUP BY s, p, o),
wholes AS (SELECT s, p, max(ord) AS e FROM known WHERE status = 1 AND o IS NULL GROUP BY s, p)
SELECT s, p, o FROM begins b LEFT JOIN ends e USING (s, p, o) LEFT JOIN wholes w USING (s, p)
WHERE (e.e IS NULL OR b.b >= e.e) AND (w.e IS NULL OR b.b >= w.e)"""


# -- 6

def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.top_subjects(table(spark, d, "triples")).select("p", "s")


P6_SQL = """
WITH n AS (SELECT p, s, count(DISTINCT o) AS n FROM triples WHERE p IS NOT NULL AND s IS NOT NULL AND o IS NOT NULL GROUP BY p, s)
SELECT p, s FROM n QUALIFY row_number() OVER (PARTITION BY p ORDER BY n DESC, s) = 1"""


def p6_pauses(spark: SparkSession, d: str) -> DataFrame:
    """For each predicate the longest time between two loads, in microseconds: an ordered fold with merged edges."""
    return skew.longest_pauses(table(spark, d, "triples"))


P6_PAUSES_SQL = """
WITH t AS (SELECT p, epoch_us(loaded_at) AS us FROM triples WHERE p IS NOT NULL AND loaded_at IS NOT NULL),
d AS (SELECT p, us - lag(us) OVER (PARTITION BY p ORDER BY us) AS pause FROM t)
SELECT p, coalesce(max(pause), 0) AS pause FROM d GROUP BY p"""


QUERIES = {f.__name__: f for f in (p1_found, p1_current, p2_found, p2_paths, p2_descendants, p3_found, p3_wide, p4_found, p4_triples, p5_found, p5_batches, p6_found, p6_pauses)}
SQL = {
    "p1_found": P1_SQL, "p1_current": P1_CURRENT_SQL, "p2_found": P2_SQL, "p2_paths": P2_PATHS_SQL, "p2_descendants": P2_DESCENDANTS_SQL,
    "p3_found": P3_SQL, "p3_wide": P3_WIDE_SQL, "p4_found": P4_SQL, "p5_found": P5_SQL, "p5_batches": P5_SQL, "p6_found": P6_SQL, "p6_pauses": P6_PAUSES_SQL,
}
