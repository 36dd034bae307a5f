"""The operators of this subpackage bound to the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from . import byte_bpe, centroids, hashing, licenses, lineruns, neardup, packing, qda, quality_rules, sharding, substring, topk, whitening
from .rows import prepared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, path: fn(prepared(spark), path)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


@query("op1_byte_bpe")
def byte_bpe_round_trip(spark: SparkSession, path: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = table(spark, path, "documents").select("doc_id", byte_bpe.encode(F.col("text"), *vocabulary).alias("ids"))
    back = ids.withColumn("decoded", byte_bpe.decode(F.col("ids"), *vocabulary))
    return back.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def packed(docs: DataFrame) -> DataFrame:
    ids = docs.select("doc_id", packing.tokenise(F.col("text"), public_tokenizers.path("word_bpe_49k.json"), 1).alias("ids"))
    pieces = packing.cut(ids, "ids").withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces, ["doc_id", "start", "ids_crc32"])


@query("op2_packing")
def packing_all(spark: SparkSession, path: str) -> DataFrame:
    return packed(table(spark, path, "documents")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@query("op4_quality_rules")
def rules_all(spark: SparkSession, path: str) -> DataFrame:
    docs = table(spark, path, "documents").select("doc_id", "text")
    model = quality_rules.fit(docs, table(spark, path, "labels"))
    return quality_rules.rules(docs, model).drop("text")


@query("op10_quality_qda")
def qda_all(spark: SparkSession, path: str) -> DataFrame:
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    docs = table(spark, path, "documents").select("doc_id", held.alias("held_out"), qda.features(F.col("text")).alias("x"))
    docs = materialise(docs, "statistics")
    labels = qda.agreed(table(spark, path, "labels"), "doc_id", "quality")
    model = qda.fit(docs.where(~F.col("held_out")).join(labels, F.col("doc_id") == F.col("__id")), "x", "__y")
    scored = docs.select("doc_id", "held_out", qda.score(F.col("x"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


LICENSE_SQL = """
with words as (
  select doc_id, i as block, regexp_extract_all(translate(line, '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w,
    regexp_matches(line, '{stop}') as stops
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents)
), whole as (select doc_id, flatten(list(w order by block)) as w from words group by doc_id),
phrases(p, label) as (values {phrases}),
places as (
  select doc_id, label, i - 1 as place from
    (select doc_id, label, string_split(p, ' ') as p, w, unnest(range(1, len(w) + 1)) as i from whole, phrases
     where list_has_all(w, string_split(p, ' ')))
  where w[i:i + len(p) - 1] = p
), templates(t, label, need, size, reach) as (values {templates}),
joined as (
  select doc_id, block, w, len(w) as n, count(*) filter (where len(w) = 0) over before_it + count(*) filter (where stops) over (before_it rows between unbounded preceding and 1 preceding) as part
  from words window before_it as (partition by doc_id order by block)
), line_ends as (
  select doc_id, part, sum(n) over (partition by doc_id, part order by block) as place, sum(n) over (partition by doc_id, part) as total from joined where n > 0
), parts as (select doc_id, part, flatten(list(w order by block)) as w from joined where n > 0 group by 1, 2),
near as (
  select doc_id, part, w, t, label, need, size, reach from parts, templates where len(list_intersect(list_distinct(w), string_split(t, ' '))) >= need
), pieces as (
  select doc_id, w, t, label, need, size from words, templates
  union all
  select doc_id, w[greatest(place - reach + 1, 1):place + reach], t, label, need, size from near join line_ends using (doc_id, part) where place < total
), matched as (
  select doc_id, label, max(len(list_intersect(list_distinct(w), string_split(t, ' '))) / size) as share
  from pieces where len(list_intersect(list_distinct(w), string_split(t, ' '))) >= need group by 1, 2
), base as (
  select doc_id, count(*) as n_base, min(place) as first_word, max(place) as last_word, list_distinct(list(label)) as labels from places group by 1
), own as (select doc_id, list(label) as labels, max(share) as share from matched group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ','), '') as labels,
  (case when n_base > 0 then 1.0 else coalesce(share, 0) end)::double as score
from whole left join base using (doc_id) left join own using (doc_id)
"""


def license_sql() -> str:
    own = [t for t in licenses.templates() if not t.whole]
    return LICENSE_SQL.format(
        upper=licenses.UPPER,
        lower=licenses.LOWER,
        phrases=", ".join(f"('{p}', '{label}')" for p, label in licenses.PHRASES.items()),
        templates=", ".join(f"('{' '.join(t.distinct)}', '{t.label}', {t.need}, {len(t.distinct)}, {len(t.words)})" for t in own),
        stop=licenses.STOP.replace("'", "''") + "$",
    )


@query("op3_license_scan", license_sql())
def license_all(spark: SparkSession, path: str) -> DataFrame:
    return licenses.scan(table(spark, path, "documents").select("doc_id", "text"))


@query("op5_sharding")
def sharding_all(spark: SparkSession, path: str) -> DataFrame:
    docs = table(spark, path, "documents").select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return sharding.shard(docs, "doc_id", "text").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query(
    "op6_topk",
    """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, d.vec_id, list_inner_product(q.v, d.v)::bigint as score
  from v q join v d on q.vec_id <> d.vec_id where q.vec_id % 20 = 0
)
select query_id, rank::int as rank, vec_id, score from
  (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 20
""",
)
def topk_all(spark: SparkSession, path: str) -> DataFrame:
    return topk.search(table(spark, path, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20)


@query("op7_substring_dedup")
def substring_all(spark: SparkSession, path: str) -> DataFrame:
    done = substring.dedup(table(spark, path, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.explode("removed").alias("r")).select("doc_id", "r.*")


@query(
    "op8_line_dedup",
    """
with lines as (
  select doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents)
), common as (select key from lines where key <> '' group by key having count(distinct doc_id) >= 10)
select doc_id, count(*)::bigint as n_lines, count(c.key)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where c.key is null), '')) as kept_sha256
from lines left join common c on lines.key = c.key group by doc_id
""",
)
def lines_all(spark: SparkSession, path: str) -> DataFrame:
    done = lineruns.dedup(table(spark, path, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


NEAR_SQL = """
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents
), sets as (
  select doc_id, list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s
  from words
), items as (select doc_id, unnest(s) as x from sets),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as n from items a join items b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
links as (
  select a, b from pairs join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * n >= 85 * (len(x.s) + len(y.s) - n)
), reach(a, b) as (select doc_id, doc_id from sets union select reach.a, links.b from reach join links on reach.b = links.a)
select doc_id, len(s)::bigint as n_shingles, c.component_id, doc_id = c.component_id as kept
from sets join (select a, min(b) as component_id from reach group by a) c on c.a = doc_id
"""


@query("op9_near_dedup", NEAR_SQL)
def near_all(spark: SparkSession, path: str) -> DataFrame:
    linked = neardup.link(table(spark, path, "documents").select("doc_id", "text"))
    return linked.select(
        F.col("__id").alias("doc_id"), "n_shingles", "component_id", F.col("__id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def centroid_sql(k: int = 16, rounds: int = 3) -> str:
    """Rounds of assignment and floored means, one after another."""
    parts = [
        f"""kept as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), c0 as (
  select row_number() over (order by h) - 1 as c, v from (select sha256('1:' || vec_id) as h, v from kept order by h limit {k})
)"""
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} as (
  select vec_id, v, near.d as d, near.c as c from (
    select vec_id, any_value(k.v) as v, min({{'d': list_inner_product(k.v, k.v) - 2 * list_inner_product(k.v, c.v) + list_inner_product(c.v, c.v), 'c': c.c}}) as near
    from kept k, c{i} c group by vec_id)
)""")
        if i < rounds:
            parts.append(f"""c{i + 1} as (
  select c, coalesce(m.v, c{i}.v) as v from c{i} left join (
    select c, list(floor(s / n) order by i) as v from (
      select c, i, sum(x) as s, count(*) as n from (select c, unnest(v) as x, generate_subscripts(v, 1) as i from a{i}) group by c, i)
    group by c) m using (c)
)""")
    return f"""with {", ".join(parts)}
select vec_id, c::int as cluster, d::bigint as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
  sha256(array_to_string(list_transform(c{rounds}.v, lambda x: x::bigint::varchar), ',')) as centroid_sha256
from a{rounds} join c{rounds} using (c)"""


@query("op11_centroids", centroid_sql())
def centroids_all(spark: SparkSession, path: str) -> DataFrame:
    found = centroids.cluster(table(spark, path, "embeddings"), "vec_id", "embedding", k=16, rounds=3, width=64, factor=64.0, salt="1:")
    per = centroids.inertia(found).withColumn("centroid_sha256", F.sha2(F.array_join("centroid", ","), 256)).drop("centroid")
    rows = found.assigned.withColumnRenamed("id", "vec_id").join(F.broadcast(per), "cluster")  # a row per centroid
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@query("op12_hashing")
def hashing_all(spark: SparkSession, path: str) -> DataFrame:
    return hashing.search(table(spark, path, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20)


@query("op13_whitening")
def whitening_all(spark: SparkSession, path: str) -> DataFrame:
    done = whitening.whiten(table(spark, path, "embeddings"), "vec_id", "embedding", components=16, factor=64.0, plus=1_000_000)
    return done.withColumnRenamed("id", "vec_id")


@query("pipeline")
def pipeline(spark: SparkSession, path: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, path)
