"""Documents written over recordings, and the rules they must keep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.published import FORMATS, PARTS
from ..operators import documents as D
from ..operators import schemas
from ..operators.ordered import first_k
from ..operators.schemas import compiled
from . import feeds
from .feeds import oracle_feed, spark_feed
from .registry import query

# one storyboard per event, three levels deep; some break a rule
STORY = f"""
SELECT event_id AS doc_id, k, concat('{{"schema":"', CASE WHEN k % 11 = 0 THEN 'x.storyboard/0' ELSE 'x.storyboard/1' END, '",',
  CASE WHEN k % 7 = 0 THEN '' ELSE '"title":"T",' END, '"mode":"run","scenes":[{{"id":"a","phase":"', CASE WHEN k % 5 = 0 THEN 'dream' ELSE 'setup' END,
  '","title":"one","goto":"', CASE WHEN k % 4 = 0 THEN 'zz' ELSE 'b' END, '","children":[{{"id":"b","phase":"input","title":"two","children":[{{"id":"',
  CASE WHEN k % 3 = 0 THEN 'a' ELSE 'c' END, '","phase":"output"', CASE WHEN k % 2 = 0 THEN ',"title":"three"' ELSE '' END,
  ',"stats":[1,2,3', CASE WHEN k % 9 = 0 THEN ',4,5' ELSE '' END, ']}}]}}]}},{{"id":"d","phase":"finish","title":"{{four}}"}}]}}') AS json FROM ({feeds.EV}) e"""
_S = oracle_feed(STORY)
_FLAT = f"""
s0 AS {_S},
s1 AS (SELECT doc_id, k, json_extract(json, '$.scenes') AS arr, 'scenes' AS base FROM s0),
f0 AS (SELECT doc_id, k, concat(base, '[', i, ']') AS path, 0::bigint AS depth, json_extract(arr, concat('$[', i, ']')) AS scene FROM s1, range(0, 2) r(i)),
f1 AS (SELECT doc_id, k, concat(path, '.children[0]') AS path, depth + 1 AS depth, json_extract(scene, '$.children[0]') AS scene FROM f0 WHERE json_extract(scene, '$.children') IS NOT NULL),
f2 AS (SELECT doc_id, k, concat(path, '.children[0]') AS path, depth + 1 AS depth, json_extract(scene, '$.children[0]') AS scene FROM f1 WHERE json_extract(scene, '$.children') IS NOT NULL),
flat AS (SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2)"""


def storyboards(t):
    return D.read_documents(spark_feed(t, STORY))


@query(
    "gr6_flatten_scenes",
    f"WITH {_FLAT} SELECT doc_id, path, depth, json_extract_string(scene, '$.id') AS id, json_extract_string(scene, '$.title') AS title FROM flat",
)
def _(t):
    return D.scenes(storyboards(t)).select("doc_id", "path", "depth", F.col("scene")["id"].alias("id"), F.col("scene")["title"].alias("title"))


@query(
    "chk1_storyboard_head",
    f"""WITH {_FLAT} SELECT doc_id, 'problem' AS severity, 'schema' AS rule, 'schema' AS path, 'x.storyboard/0' AS detail FROM s0 WHERE k % 11 = 0
        UNION ALL SELECT doc_id, 'problem', 'required', 'title', 'missing' FROM s0 WHERE json_extract(json, '$.title') IS NULL""",
)
def _(t):
    return D.check_storyboard_head(storyboards(t))


@query(
    "chk2_scenes",
    f"""WITH {_FLAT} SELECT doc_id, 'problem' AS severity, 'required' AS rule, concat(path, '.title') AS path, 'missing' AS detail FROM flat WHERE json_extract(scene, '$.title') IS NULL
        UNION ALL SELECT doc_id, 'problem', 'phase', concat(path, '.phase'), json_extract_string(scene, '$.phase') FROM flat
        WHERE json_extract_string(scene, '$.phase') NOT IN ('setup', 'imports', 'constants', 'definitions', 'input', 'transform', 'branch', 'output', 'finish', 'error')""",
)
def _(t):
    return D.check_scenes(D.scenes(storyboards(t)))


@query(
    "chk3_duplicate_ids",
    f"""WITH {_FLAT} SELECT doc_id, 'problem' AS severity, 'duplicate id' AS rule, json_extract_string(scene, '$.id') AS path, count(*)::varchar AS detail FROM flat
        GROUP BY doc_id, json_extract_string(scene, '$.id') HAVING count(*) > 1""",
)
def _(t):
    return D.check_duplicate_scenes(D.scenes(storyboards(t)))


@query(
    "chk8_limits",
    f"""WITH {_FLAT} SELECT doc_id, 'problem' AS severity, 'too many' AS rule, concat(path, '.stats') AS path, json_array_length(scene, '$.stats')::varchar AS detail FROM flat
        WHERE json_array_length(scene, '$.stats') > 4
        UNION ALL SELECT f.doc_id, 'problem', 'goto', f.path, json_extract_string(f.scene, '$.goto') FROM flat f WHERE json_extract_string(f.scene, '$.goto') IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM flat g WHERE g.doc_id = f.doc_id AND json_extract_string(g.scene, '$.id') = json_extract_string(f.scene, '$.goto'))""",
)
def _(t):
    docs = storyboards(t)
    return D.check_scene_limits(docs, D.scenes(docs))


# a storyboard per document that breaks the format in many ways, at every depth; the narration is the whole text
RICH = """
SELECT doc_id, concat('{"schema":"', CASE WHEN doc_id % 13 = 0 THEN 'storyboard' ELSE 'x.storyboard/1' END, '"', CASE WHEN doc_id % 7 = 0 THEN '' ELSE concat(',"title":"', repeat('t', cast(doc_id % 90 AS integer)), '"') END,
  CASE WHEN doc_id % 5 = 0 THEN ',"author":{"name":"me"}' ELSE '' END, ',"mode":"', CASE doc_id % 3 WHEN 0 THEN 'run' WHEN 1 THEN 'scan' ELSE 'walk' END,
  '","run":{"status":', CASE doc_id % 4 WHEN 0 THEN '1' WHEN 1 THEN '"late"' ELSE '"ok"' END, ',"duration_ms":', CASE WHEN doc_id % 6 = 0 THEN '"1"' ELSE '1.5' END, ',"args":["a",', CASE WHEN doc_id % 6 = 1 THEN 'null' ELSE '"b"' END, '],"safe_mode":', CASE WHEN doc_id % 9 = 0 THEN '"yes"' ELSE 'true' END,
  '},"scenes":[', CASE WHEN doc_id % 11 = 0 THEN '' ELSE concat('{"id":"', CASE WHEN doc_id % 8 = 0 THEN 'Bad id' ELSE 's1' END, '","phase":"', CASE WHEN doc_id % 5 = 1 THEN 'dream' ELSE 'setup' END, '","title":"one","narration":"', regexp_replace(text, '[^A-Za-z ]', '.'),
  '","branch":{"condition":"c","paths":[{"label":"l","status":"taken"}', CASE WHEN doc_id % 2 = 0 THEN ',{"label":"m","goto":7}' ELSE '' END, ']},"inputs":[{"kind":"file","label":"x","code":{"line":', CASE WHEN doc_id % 4 = 3 THEN '1.5' ELSE '2.0' END, ',"highlight":[1,"2"]},"data":{"rows":', doc_id, ',"sample":{"rows":[["1",', CASE WHEN doc_id % 3 = 0 THEN '2' ELSE '"2"' END, '],["3"]]}}}],
  "children":[{"id":"c1","phase":"input","title":"', repeat('x', cast(doc_id % 70 AS integer)), '","children":[{"id":"-d","phase":"output","stats":[{"label":"a","value":1,"unit":"', repeat('u', cast(doc_id % 15 AS integer)), '"},{"value":true}', repeat(',{"label":"b","value":"2"}', cast(doc_id % 5 AS integer)), '],"extra":', CASE WHEN doc_id % 2 = 1 THEN '1' ELSE '{"deep":[1]}' END, '}]}]}') END,
  ']', CASE WHEN doc_id % 17 = 0 THEN '' ELSE ',"summary":{"notes":["", "a", "b", "c", "d", "e"],"stats":7}}' END) AS json
FROM {documents}"""


def _sql_schema(docs: str, form: str) -> str:
    """The tables of the schema, and a walk over the nodes of each document by recursion."""
    edges, rules = compiled(FORMATS, PARTS)

    def rows(table):
        return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in table)

    return f"""WITH RECURSIVE edges(t, step, below) AS (VALUES {rows(edges)}), rules(t, keyword, value) AS (VALUES {rows(rules)}),
      docs AS {docs},
      tree AS (SELECT d.doc_id, j.id, j.parent, j.key, j.type AS jt, j.value AS v, j.atom FROM docs d, json_tree(d.json) j WHERE json_valid(d.json)),
      n(doc_id, id, path, t, jt, v, atom) AS (
        SELECT doc_id, id, '', '{form}', jt, v, atom FROM tree WHERE parent IS NULL
        UNION ALL SELECT c.doc_id, c.id, CASE WHEN n.jt = 'ARRAY' THEN concat(n.path, '[', c.key, ']') WHEN n.path = '' THEN c.key ELSE concat(n.path, '.', c.key) END,
          coalesce(e.below, o.below, ''), c.jt, c.v, c.atom
        FROM n JOIN tree c ON c.doc_id = n.doc_id AND c.parent = n.id
        LEFT JOIN edges e ON e.t = n.t AND e.step = CASE WHEN n.jt = 'ARRAY' THEN '[]' ELSE c.key END LEFT JOIN edges o ON o.t = n.t AND o.step = '*'),
      k AS (SELECT *, CASE jt WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null'
          WHEN 'DOUBLE' THEN CASE WHEN atom::double = floor(atom::double) THEN 'integer' ELSE 'number' END ELSE 'integer' END AS kind,
          json_extract_string(v, '$') AS s, CASE jt WHEN 'ARRAY' THEN json_array_length(v)::bigint WHEN 'VARCHAR' THEN length(json_extract_string(v, '$')) END AS size FROM n),
      x AS (SELECT k.*, keyword, value, CASE WHEN keyword IN ('type', 'enum', 'required', 'closed') THEN from_json(value, '["VARCHAR"]') END AS words FROM k JOIN rules USING (t)),
      f AS (
        SELECT doc_id, keyword, path, kind AS detail FROM x WHERE keyword = 'type' AND NOT list_contains(words, kind) AND NOT (kind = 'integer' AND list_contains(words, 'number'))
        UNION ALL SELECT doc_id, keyword, path, coalesce(s, '') FROM x WHERE keyword = 'enum' AND NOT (kind = 'string' AND list_contains(words, s))
        UNION ALL SELECT doc_id, keyword, path, s FROM x WHERE keyword = 'pattern' AND kind = 'string' AND NOT regexp_matches(s, value)
        UNION ALL SELECT doc_id, keyword, path, size::varchar FROM x WHERE (keyword = 'minLength' AND kind = 'string' OR keyword = 'minItems' AND kind = 'array') AND size < value::bigint
        UNION ALL SELECT doc_id, keyword, path, size::varchar FROM x WHERE (keyword = 'maxLength' AND kind = 'string' OR keyword = 'maxItems' AND kind = 'array') AND size > value::bigint
        UNION ALL SELECT doc_id, keyword, concat(path, CASE WHEN path = '' THEN '' ELSE '.' END, w), 'missing' FROM (SELECT *, unnest(words) AS w FROM x WHERE keyword = 'required' AND kind = 'object')
          WHERE NOT list_contains(json_keys(v), w)
        UNION ALL SELECT doc_id, keyword, concat(path, CASE WHEN path = '' THEN '' ELSE '.' END, w), 'unknown field' FROM (SELECT *, unnest(json_keys(v)) AS w FROM x WHERE keyword = 'closed' AND kind = 'object')
          WHERE NOT list_contains(words, w)
        UNION ALL SELECT doc_id, keyword, concat(path, CASE WHEN path = '' THEN '' ELSE '.' END, w), 'name' FROM (SELECT *, unnest(json_keys(v)) AS w FROM x WHERE keyword = 'names' AND kind = 'object')
          WHERE NOT regexp_matches(w, value)
        UNION ALL SELECT doc_id, 'type', '', 'not JSON' FROM docs WHERE NOT json_valid(json))
      SELECT doc_id, 'problem' AS severity, keyword AS rule, path, detail FROM f"""


@query("chk8_schema", _sql_schema("(" + RICH.replace("'.')", "'.', 'g')").replace("{documents}", "documents") + ")", "storyboard/1"))
def _(t):
    return schemas.check(spark_feed(t, RICH).withColumn("format", F.lit("storyboard/1")), FORMATS, PARTS)


# one walkthrough per document: its title begins like the text, its first explanation is the whole text
WALK = """
SELECT doc_id, n_chars, concat('{"schema":"x.walkthrough/1","title":"', regexp_replace(substring(text, 1, 20 + cast(n_chars % 90 AS integer)), '[^A-Za-z ]', '.'), '"',
  CASE WHEN doc_id % 6 = 0 THEN ',"author":"me"' ELSE '' END, ',"entry":"main","explanations":{"a.py:', doc_id % 40, '":{"title":"x","text":"', CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE regexp_replace(text, '[^A-Za-z ]', '.') END,
  '"},"b.py:', doc_id % 30, '":{"title":"', repeat('t', cast(doc_id % 80 AS integer)), '","text":"y"', CASE WHEN doc_id % 5 = 0 THEN ',"why":"z"' ELSE '' END,
  '},"bad', doc_id % 3, '":{"title":"x","text":"y"}},"notes":{"s', doc_id % 12, '":"', repeat('n', cast(n_chars % 400 AS integer)), '"}}') AS json
FROM {documents}"""


def _sql_walk() -> str:
    # the checking engine replaces only the first match unless told otherwise
    return "(" + WALK.replace("'.')", "'.', 'g')").replace("{documents}", "documents") + ")"


_W = _sql_walk()
_DST = "(SELECT doc_id, concat(f, ':', n) AS stmt, n % 2 = 0 AS shown, n % 6 = 0 AS tail, n FROM documents, (SELECT unnest(['a.py', 'b.py']) AS f) x, range(1, 26) r(n))"


def walkthroughs(t):
    return D.read_documents(spark_feed(t, WALK))


def statements_of(t):
    """Statements recorded for each document: lines 1 to 25 of two files."""
    n = F.explode(F.sequence(F.lit(1), F.lit(25))).alias("n")
    d = t.documents.select("doc_id", n).select("doc_id", "n", F.explode(F.array(F.lit("a.py"), F.lit("b.py"))).alias("f"))
    return d.select(
        "doc_id", F.concat_ws(":", "f", "n").alias("stmt"), (F.col("n") % 2 == 0).alias("shown"), (F.col("n") % 6 == 0).alias("tail"), "n"
    )


@query(
    "chk4_walkthrough_head",
    f"""SELECT doc_id, 'problem' AS severity, 'unknown field' AS rule, 'author' AS path, '' AS detail FROM {_W} w WHERE doc_id % 6 = 0
        UNION ALL SELECT doc_id, 'problem', 'too long', 'title', length(json_extract_string(json, '$.title'))::varchar FROM {_W} w
        WHERE trim(json_extract_string(json, '$.title')) <> '' AND length(json_extract_string(json, '$.title')) > 80
        UNION ALL SELECT doc_id, 'problem', 'required', 'title', 'missing' FROM {_W} w WHERE trim(json_extract_string(json, '$.title')) = ''""",
)
def _(t):
    return D.check_walkthrough_head(walkthroughs(t))


@query("chk8_walkthrough_schema", _sql_schema(f"(SELECT doc_id, json FROM {_W} w)", "walkthrough/1"))
def _(t):
    return schemas.check(spark_feed(t, WALK).withColumn("format", F.lit("walkthrough/1")), FORMATS, PARTS)


_EXP = f"""(SELECT doc_id, concat('a.py:', doc_id % 40) AS stmt, 'x' AS title, CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE regexp_replace(text, '[^A-Za-z ]', '.', 'g') END AS text FROM documents
  UNION ALL SELECT doc_id, concat('b.py:', doc_id % 30), repeat('t', cast(doc_id % 80 AS integer)), 'y' FROM documents
  UNION ALL SELECT doc_id, concat('bad', doc_id % 3), 'x', 'y' FROM documents)"""


@query(
    "chk5_explanations",
    rf"""WITH x AS (SELECT e.*, s.stmt IS NOT NULL AS known, regexp_matches(e.stmt, '^.+:[0-9]+(#[0-9]+)?$') AS well FROM {_EXP} e LEFT JOIN {_DST} s USING (doc_id, stmt))
        SELECT doc_id, 'problem' AS severity, 'statement id' AS rule, stmt AS path, 'expected file:line' AS detail FROM x WHERE NOT well
        UNION ALL SELECT doc_id, 'problem', 'no such statement', stmt, '' FROM x WHERE well AND NOT known
        UNION ALL SELECT doc_id, 'problem', 'required', concat(stmt, '.title'), 'missing' FROM x WHERE well AND known AND trim(title) = ''
        UNION ALL SELECT doc_id, 'problem', 'too long', concat(stmt, '.title'), length(title)::varchar FROM x WHERE well AND known AND length(title) > 60
        UNION ALL SELECT doc_id, 'problem', 'required', concat(stmt, '.text'), 'missing' FROM x WHERE well AND known AND trim(text) = ''
        UNION ALL SELECT doc_id, 'problem', 'too long', concat(stmt, '.text'), length(text)::varchar FROM x WHERE well AND known AND length(text) > 700
        UNION ALL SELECT doc_id, 'problem', 'unknown field', concat(stmt, '.why'), '' FROM x WHERE known AND starts_with(stmt, 'b.py') AND doc_id % 5 = 0""",
)
def _(t):
    return D.check_explanations(D.explanations(walkthroughs(t)), statements_of(t))


@query("chk5_lengths", "SELECT doc_id, length(text) AS n, length(text) > 700 AS over, length(trim(text, ' ')) = 0 AS blank FROM documents")
def _(t):
    return t.documents.select(
        "doc_id", F.length("text").cast("long").alias("n"), (F.length("text") > 700).alias("over"), (F.length(F.trim("text")) == 0).alias("blank")
    )


@query(
    "chk6_notes",
    """WITH x AS (SELECT doc_id, concat('s', doc_id % 12) AS step, n_chars % 400 AS n, doc_id % 12 BETWEEN 1 AND 9 AS known FROM documents)
       SELECT doc_id, 'problem' AS severity, 'no such step' AS rule, step AS path, '' AS detail FROM x WHERE NOT known
       UNION ALL SELECT doc_id, 'problem', 'note', step, n::varchar FROM x WHERE known AND (n = 0 OR n > 300)""",
)
def _(t):
    steps = t.documents.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("n")).select("doc_id", F.concat(F.lit("s"), "n").alias("step"))
    return D.check_notes(walkthroughs(t), steps)


_WARN = f"""
e AS {_EXP}, st AS {_DST},
wn AS (SELECT doc_id, 'warning' AS severity, CASE WHEN NOT shown THEN 'not shown' ELSE 'inside a group' END AS rule, stmt AS path, '' AS detail
       FROM e JOIN st USING (doc_id, stmt) WHERE NOT shown OR tail
       UNION ALL SELECT doc_id, 'warning', 'many', 'explanations', count(DISTINCT stmt)::varchar FROM e GROUP BY doc_id HAVING count(DISTINCT stmt) > 2
       UNION ALL SELECT doc_id, 'warning', 'coverage', 'explanations', concat(missing, '/', top) FROM (
         SELECT doc_id, count(*) AS top, count(*) FILTER (WHERE e.stmt IS NULL AND NOT tail) AS missing FROM
           (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n, stmt) <= 20) s LEFT JOIN e USING (doc_id, stmt) GROUP BY doc_id) c
       WHERE missing > floor(top / 2))"""


def warnings(t):
    st = statements_of(t)
    ranked = first_k(st, ["doc_id"], ["n", "stmt"], 20, "place").select("doc_id", "stmt", "place")
    # asked three times: the whole documents are parsed once
    explained = t.once("explained", lambda: D.explanations(walkthroughs(t)).select("doc_id", "stmt"))
    return D.check_shown(explained, st.drop("n"), 2, ranked)


@query("chk7_warnings", f"WITH {_WARN} SELECT * FROM wn")
def _(t):
    return warnings(t)


@query(
    "chk9_gate",
    f"""WITH {_WARN} SELECT d.doc_id, d.doc_id % 10 = 0 AS forced, coalesce(p, 0) AS problems, coalesce(w, 0) AS warnings, coalesce(p, 0) = 0 OR d.doc_id % 10 = 0 AS built
        FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS w FROM wn GROUP BY 1) w USING (doc_id)
        LEFT JOIN (SELECT doc_id, count(*) AS p FROM (SELECT doc_id FROM {_W} w WHERE doc_id % 6 = 0
          UNION ALL SELECT doc_id FROM {_W} w WHERE trim(json_extract_string(json, '$.title')) = '' OR length(json_extract_string(json, '$.title')) > 80) GROUP BY 1) p USING (doc_id)""",
)
def _(t):
    docs = walkthroughs(t)
    found = D.check_walkthrough_head(docs).unionByName(warnings(t))
    return D.verdicts(docs, found, F.col("doc_id") % 10 == 0)


@query("chk11_budget", "SELECT source, sum(length(text))::bigint AS chars FROM documents GROUP BY source HAVING sum(length(text)) > 60000")
def _(t):
    return t.documents.groupBy("source").agg(F.sum(F.length("text")).alias("chars")).filter("chars > 60000")


_BUNDLE = f"""SELECT event_id AS doc_id, concat('{{"mode":"run"', CASE WHEN k % 3 > 0 THEN ',"view":"walkthrough"' ELSE '' END, CASE WHEN k % 4 > 0 THEN ',"plan":{{"steps":[]}}' ELSE '' END, '}}') AS json FROM ({feeds.EV}) e"""


@query("chk12_consistency", f"SELECT doc_id, json_extract_string(json, '$.view') IS NOT NULL AND json_extract(json, '$.plan') IS NOT NULL AS usable FROM {oracle_feed(_BUNDLE)} b")
def _(t):
    b = spark_feed(t, _BUNDLE).withColumn("doc", D.fields(F.col("json")))
    usable = F.coalesce(F.col("doc")["view"] == "walkthrough", F.lit(False)) & F.map_contains_key("doc", "plan")
    return b.select("doc_id", usable.alias("usable"))


@query(
    "chk13_payload",
    f"""SELECT w.doc_id, concat('{{"title":"', json_extract_string(json, '$.title'), '","subtitle":"","mode":"run","entry":"main","run":{{"status":"',
        CASE WHEN toxic = 1 THEN 'error' ELSE 'ok' END, '","duration_ms":', w.n_chars, ',"args":["', quality, '"]', CASE WHEN toxic = 1 THEN ',"error":"ValueError"' ELSE '' END,
        '}},"n_steps":', quality + 1, '}}') AS payload FROM {_W} w JOIN labels l ON l.doc_id = w.doc_id""",
)
def _(t):
    runs = t.labels.join(t.documents.select("doc_id", F.col("n_chars").alias("duration_ms")), "doc_id").select(
        "doc_id", F.lit("run").alias("mode"), F.lit("main.py").alias("entry"), F.when(F.col("toxic") == 1, "error").otherwise("ok").alias("status"),
        "duration_ms", F.array(F.col("quality").cast("string")).alias("args"), F.when(F.col("toxic") == 1, "ValueError").alias("error"),
        (F.col("quality") + 1).alias("n_steps"),
    )
    return D.payload(walkthroughs(t), runs)


@query(
    "src6_documents",
    f"SELECT doc_id, 'storyboard/1' AS kind, json_extract_string(json, '$.mode') AS mode FROM {_S} s WHERE k % 11 <> 0",
)
def _(t):
    from ..session import scratch_path
    from ..sources.recordings import read_document_files

    path = scratch_path(t.spark, "documents")
    # one JSON document per line; the kind is told by the schema field
    spark_feed(t, STORY).select("doc_id", "json").write.json(path)
    docs = read_document_files(t.spark, path)
    return docs.filter("kind = 'storyboard/1'").select("doc_id", "kind", F.col("doc")["mode"].alias("mode"))


@query(
    "src6_document_folder",
    """SELECT n_nationkey AS nation, CASE WHEN n_nationkey % 3 = 0 THEN 'walkthrough/1' WHEN n_nationkey % 3 = 1 THEN 'storyboard/1' ELSE '' END AS kind,
       CASE WHEN n_nationkey % 3 < 2 THEN count(c_custkey)::varchar END AS title
       FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey""",
)
def _(t):
    """A folder of whole documents, one file a nation; a third of them are no JSON."""
    from ..session import scratch_path
    from ..sources.recordings import read_document_folder

    per = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey").agg(F.count("c_custkey").alias("n"))
    kind = F.when(F.col("n_nationkey") % 3 == 0, "x.walkthrough/1").otherwise("x.storyboard/1")
    text = F.concat(F.lit('{\n "schema": "'), kind, F.lit('",\n "title": "'), "n", F.lit('"\n}'))
    docs = per.select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 2, "no document\n").otherwise(text).alias("value"))
    path = scratch_path(t.spark, "folder")
    docs.write.partitionBy("n_nationkey").text(path)
    nation = F.regexp_extract("doc_id", "n_nationkey=([0-9]+)", 1).cast("int").alias("nation")
    return read_document_folder(t.spark, path).select(nation, "kind", F.col("doc")["title"].alias("title"))
