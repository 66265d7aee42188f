"""Queries of loops, relations, epochs and parallel file scans, each beside its DuckDB SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as t
from plumbline.functions import vectors as v
from plumbline.operators import decode, relation, resize, sampler
from plumbline.plans import oracles
from plumbline.plans.queries import REGIONS, WIDTH, captions, load
from plumbline.sources import caption_sink, json_split, sinks
from plumbline.sources.feature_cache import FeatureCache
from plumbline.stored import shared_folder
from plumbline.streaming import run_states

BEAM, BEAM_TOKENS, GREEDY_TOKENS = 3, 7, 12
WORLD, EPOCHS = 8, (1, 2)
SHARE, DRAW_SEED = 0.24, 5
_TOKS = "regexp_extract_all(lower(text), '[a-z0-9'']+')"


def json_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written out as JSON objects with an array of records, and read back by byte ranges."""
    path = f"{shared_folder(spark)}/turns-{uuid.uuid4().hex}"
    sinks.write_array_files(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), path, "turns")
    found = json_split.read_records(spark, path, "turns", "conv_id bigint, turn bigint, role string, text string")
    return found.select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))


def _layers() -> tuple[tuple[relation.Layer, relation.Layer], tuple[relation.Layer, relation.Layer]]:
    """Fixed weights of the test query: small fractions by place."""
    def layer(n: int, wide: int) -> relation.Layer:
        r, c = np.arange(WIDTH)[:, None], np.arange(wide)[None, :]
        return relation.Layer(((r * 31 + c * 17 + n * 7) % 23 - 11) / 64.0, ((np.arange(WIDTH) * 5 + n) % 7 - 3) / 16.0)

    return (layer(0, 2 * WIDTH), layer(1, WIDTH)), (layer(2, 2 * WIDTH), layer(3, WIDTH))


def relation_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first K vectors of each label after a round of messages with edge and node functions."""
    edge, node = _layers()
    found = relation.relation_update(load(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", REGIONS, edge, node)
    return found.select("label", "slot", F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.round("value", 6) + 0.0)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _decoded(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    """Every document goes on from its first token; equal beginnings are decoded once."""
    docs = _texts(spark, sf_dir)
    step = decode.successors(docs, F.col("text"), how["width"] + how["most"])
    own = docs.select("doc_id", t.first_token(F.col("text")).alias("first"))
    start = own.where("first is not null").select("first", F.col("first").alias("token")).distinct()
    found = decode.decode(start, step, "first", **how)
    return own.join(found, "first", "left").select("doc_id", F.coalesce(F.size("tokens"), F.lit(0)).cast("long").alias("n_tokens"), F.coalesce(F.array_join("tokens", " "), F.lit("")).alias("caption"), F.coalesce("score", F.lit(0)).cast("long").alias("score"))


def beam_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, width=BEAM, most=BEAM_TOKENS, alpha=0.7, no_repeat=3)


def greedy_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, width=1, most=GREEDY_TOKENS, end=None, no_repeat=0)


def scheduled_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a decoder is fed for each document, with a share of its inputs predicted from the one before."""
    found = decode.scheduled_inputs(_texts(spark, sf_dir), "doc_id", "text", None, SHARE, DRAW_SEED)
    return found.select("doc_id", F.size("inputs").cast("long").alias("n_inputs"), F.md5(F.array_join("inputs", " ")).alias("inputs_md5"))


def sampler_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two epochs of the documents in a keyed order, dealt to eight ranks of equal size."""
    return sampler.dealt(load(spark, sf_dir, "documents").select("doc_id"), "doc_id", WORLD, 42, list(EPOCHS))


def stream_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as batches of the runs of their customers, read as a stream: totals, thresholds and bests from state."""
    orders = load(spark, sf_dir, "orders")
    folder = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(orders.schema).parquet(f"{sf_dir}/orders.parquet*").withColumn("samples", F.col("o_orderkey") % 700 + 1)
    before = run_states.use_store(spark)
    try:
        found = run_states.run_states(stream, "o_custkey", "o_orderkey", "samples", "o_totalprice", 500)
        run_states.write_available(found, f"{folder}/out", f"{folder}/state")
    finally:
        run_states.restore_store(spark, before)
    return spark.read.parquet(f"{folder}/out").withColumnsRenamed({"run": "o_custkey", "batch": "o_orderkey"})


def resized_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as images of 8 x 8 pixels at 5 x 11, bilinear, corners not aligned."""
    found = resize.resize_images(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", (1, 8, 8), 5, 11)
    return found.select("vec_id", F.posexplode("embedding").alias("at", "value")).withColumn("value", F.round("value", 6) + 0.0)


def feature_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of documents through a cache in two batches that share keys; the second finds the first's."""
    docs = load(spark, sf_dir, "documents")
    cache = FeatureCache(spark, f"{shared_folder(spark)}/features-{uuid.uuid4().hex}", "doc_id")
    compute = lambda keys: docs.join(keys, "doc_id").select("doc_id", F.length("text").cast("long").alias("chars"))
    cache.read_through("labelled", load(spark, sf_dir, "labels"), compute)
    known = cache.table().select("doc_id", F.lit(True).alias("was_there"))
    found = cache.read_through("all", docs, compute, whole=False)
    return found.join(known, "doc_id", "left").select("doc_id", "chars", F.coalesce("was_there", F.lit(False)).alias("was_there"))


def sink_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions written by the sink that counts as it writes; its header, one row a rule."""
    caption_sink.register(spark)
    path = f"{shared_folder(spark)}/captions-{uuid.uuid4().hex}"
    captions(spark, sf_dir).write.format("caption_json").mode("overwrite").option("path", path).save()
    head = spark.read.schema("num_samples bigint, rule_counts map<string,bigint>").json(f"{path}/{caption_sink.HEADER}")
    return head.select("num_samples", F.explode("rule_counts").alias("rule", "n"))


QUERIES = {f.__name__: f for f in (json_turns, relation_update, beam_captions, greedy_captions, scheduled_mix, sampler_ranks, stream_runs, resized_images, feature_cache, sink_header)}

_W = "((r * 31 + c * 17 + {0} * 7) % 23 - 11) / 64.0::DOUBLE"
_B = "((r * 5 + {0}) % 7 - 3) / 16.0::DOUBLE"
_RELATION = f"""
WITH vec AS (
  SELECT label, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS slot, embedding::DOUBLE[] AS x FROM embeddings QUALIFY slot < {REGIONS}
),
x AS (SELECT label, slot, unnest(generate_series(0, {WIDTH - 1}))::INT AS c, unnest(x) AS v FROM vec),
rows_ AS (SELECT unnest(generate_series(0, {WIDTH - 1}))::INT AS r),
p AS (SELECT label, slot, r, sum({_W.format(0)} * v) + any_value({_B.format(0)}) AS p, sum((((r * 31 + (c + {WIDTH}) * 17) % 23 - 11) / 64.0::DOUBLE) * v) AS q FROM x, rows_ GROUP BY label, slot, r),
h AS (SELECT a.label, a.slot, a.r AS c, avg(greatest(a.p + b.q, 0::DOUBLE)) AS v FROM p a JOIN p b ON a.label = b.label AND a.r = b.r GROUP BY a.label, a.slot, a.r),
m AS (SELECT label, slot, r + {WIDTH} AS c, sum({_W.format(1)} * v) + any_value({_B.format(1)}) AS v FROM h, rows_ GROUP BY label, slot, r),
n AS (SELECT label, slot, r AS c, greatest(sum({_W.format(2)} * v) + any_value({_B.format(2)}), 0::DOUBLE) AS v FROM (SELECT * FROM x UNION ALL SELECT * FROM m), rows_ GROUP BY label, slot, r),
o AS (SELECT label, slot, r AS c, sum({_W.format(3)} * v) + any_value({_B.format(3)}) AS v FROM n, rows_ GROUP BY label, slot, r)
SELECT label, slot, c AS dim, round(x.v + o.v, 6) + 0 AS value FROM x JOIN o USING (label, slot, c)
"""

_BIGRAMS = f"""
toks AS MATERIALIZED (SELECT doc_id, {_TOKS} AS ws FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
pairs AS (SELECT unnest(ws) AS token, unnest(list_append(ws[2:], '{decode.END}')) AS next FROM toks WHERE len(ws) > 0),
counts AS (SELECT token, next, count(*) AS n FROM pairs GROUP BY token, next),
big AS MATERIALIZED (SELECT token, next, round({float(decode.UNIT)}::DOUBLE * ln(n::DOUBLE / (sum(n) OVER (PARTITION BY token))::DOUBLE))::BIGINT AS lp FROM counts)"""


def _decode_sql(width: int, most: int, alpha: float, ends: bool, blocks: bool) -> str:
    """Rounds one after another, each a join with the bigrams and a window."""
    done = f"next IS NULL OR next = '{decode.END}'" if ends else "next IS NULL"
    block = "len(list_filter(generate_series(1, len(seq) - 2), lambda i: seq[i] = seq[len(seq) - 1] AND seq[i + 1] = seq[len(seq)] AND seq[i + 2] = next)) = 0" if blocks else "true"
    steps = ["s1 AS (SELECT DISTINCT ws[1] AS item, 0::BIGINT AS beam, 0::BIGINT AS score, [ws[1]] AS seq, false AS done FROM toks WHERE len(ws) > 0)"]
    for k in range(1, most):
        steps.append(f"""go{k} AS (
  SELECT item, beam, score + lp AS score, seq, next FROM s{k} JOIN big ON token = seq[len(seq)] WHERE NOT done AND {block}
),
all{k} AS (
  SELECT * FROM go{k} UNION ALL SELECT item, beam, score, seq, NULL FROM s{k} WHERE done OR NOT EXISTS (SELECT 1 FROM go{k} g WHERE g.item = s{k}.item AND g.beam = s{k}.beam)
),
s{k + 1} AS MATERIALIZED (
  SELECT item, nth AS beam, score, seq, done FROM (SELECT item, row_number() OVER (PARTITION BY item ORDER BY score DESC, beam, next) - 1 AS nth, score, CASE WHEN next IS NULL THEN seq ELSE list_append(seq, next) END AS seq, {done} AS done
  FROM all{k}) WHERE nth < {width}
)""")
    return f"""WITH {_BIGRAMS},
{",".join(steps)},
best AS (SELECT item, seq, score, row_number() OVER (PARTITION BY item ORDER BY score / pow(len(seq)::DOUBLE, {alpha}::DOUBLE) DESC, beam) AS nth FROM s{most})
SELECT doc_id, coalesce(len(seq), 0)::BIGINT AS n_tokens, coalesce(array_to_string(seq, ' '), '') AS caption, coalesce(score, 0)::BIGINT AS score
FROM toks LEFT JOIN best ON item = ws[1] AND nth = 1"""


def _feistel_sql(x: str) -> str:
    """The network of ``sampler.permuted`` on ``bits`` bits, as nested selects over l and r."""
    sql = f"SELECT epoch, id, steps, {x} >> rb AS l, {x} & ((1::BIGINT << rb) - 1) AS r, lb, rb FROM walked, sizes WHERE steps = 0 OR {x} >= n"
    for k in range(sampler.ROUNDS):
        mask = ("lb", "rb")[k % 2]
        sql = f"SELECT epoch, id, steps, r AS l, xor(l, ('0x' || md5((42 + epoch) || ':{k}:' || r)[1:8])::BIGINT & ((1::BIGINT << {mask}) - 1)) AS r, lb, rb FROM ({sql})"
    return f"SELECT epoch, id, (l << rb) + r AS x, steps + 1 AS steps FROM ({sql})"


_SAMPLER = f"""
WITH RECURSIVE sizes AS (
  SELECT n, bits // 2 AS lb, bits - bits // 2 AS rb FROM (SELECT n, greatest(2, length(ltrim(bin(n - 1), '0'))) AS bits FROM (SELECT count(*)::BIGINT AS n FROM documents))
),
ids AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS id FROM documents),
walked(epoch, id, x, steps) AS (
  SELECT epoch, id, id, 0 FROM ids, (VALUES {", ".join(f"({e})" for e in EPOCHS)}) AS e(epoch)
  UNION ALL
  SELECT * FROM ({_feistel_sql("x")})
),
placed AS (SELECT epoch, id, x AS place FROM walked, sizes WHERE steps > 0 AND x < n),
dealt AS (
  SELECT epoch, doc_id, unnest(generate_series(place, -(-n // {WORLD}) * {WORLD} - 1, n)) AS pos FROM placed JOIN ids USING (id), sizes
)
SELECT doc_id, epoch, (pos % {WORLD})::INT AS rank, (pos // {WORLD})::BIGINT AS slot FROM dealt
""".replace("-(-n // ", "((n + 7) // ")

_MIX = f"""
WITH RECURSIVE {_BIGRAMS},
best AS (SELECT token, next FROM big QUALIFY row_number() OVER (PARTITION BY token ORDER BY lp DESC, next) = 1),
said AS (SELECT doc_id, unnest(ws) AS token, unnest(generate_series(0, len(ws) - 1)) AS pos FROM toks WHERE len(ws) > 0),
kept AS (
  SELECT *, CASE WHEN pos > 0 AND ('0x' || md5('{DRAW_SEED}:' || doc_id || ':' || pos)[1:8])::BIGINT < {round(SHARE * (1 << 32))} THEN NULL ELSE pos END AS own FROM said
),
runs AS (SELECT k.doc_id, k.pos, o.token AS origin, k.pos - k.at_own AS run FROM (
  SELECT *, max(own) OVER (PARTITION BY doc_id ORDER BY pos) AS at_own FROM kept) k JOIN said o ON o.doc_id = k.doc_id AND o.pos = k.at_own),
chain(origin, run, token) AS (
  SELECT DISTINCT origin, 0::BIGINT, origin FROM runs
  UNION ALL
  SELECT origin, run + 1, coalesce(next, token) FROM chain LEFT JOIN best USING (token) WHERE run < (SELECT max(run) FROM runs)
)
SELECT doc_id, count(*) AS n_inputs, md5(string_agg(token, ' ' ORDER BY pos)) AS inputs_md5 FROM runs JOIN chain USING (origin, run) GROUP BY doc_id
UNION ALL SELECT doc_id, 0, md5('') FROM toks WHERE len(ws) = 0
"""

ORACLES = {
    "json_turns": "SELECT conv_id, turn, role, length(text) AS chars, md5(text) AS text_md5 FROM conversations", "relation_update": _RELATION,
    "beam_captions": _decode_sql(BEAM, BEAM_TOKENS, 0.7, True, True), "greedy_captions": _decode_sql(1, GREEDY_TOKENS, 0.7, False, False),
    "stream_runs": """WITH s AS (
  SELECT o_custkey, o_orderkey, o_orderkey % 700 + 1 AS samples, o_totalprice, (sum(o_orderkey % 700 + 1) OVER w)::BIGINT AS seen, max(o_totalprice) OVER w AS best FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)
)
SELECT o_custkey, o_orderkey, seen, seen // 500 - (seen - samples) // 500 AS saves, (seen // 500 + 1) * 500 AS next_at, best,
  o_totalprice > coalesce(max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-inf'::DOUBLE) AS improved
FROM s""",
    "resized_images": """WITH p AS (SELECT a * 11 + b AS spot, greatest(0, least(7, (a + 0.5::DOUBLE) * 1.6::DOUBLE - 0.5::DOUBLE)) AS y, greatest(0, least(7, (b + 0.5::DOUBLE) * (8 / 11::DOUBLE) - 0.5::DOUBLE)) AS x
  FROM (SELECT unnest(generate_series(0, 4)) AS a), (SELECT unnest(generate_series(0, 10)) AS b)),
c AS (SELECT spot, floor(y)::INT AS y0, least(floor(y)::INT + 1, 7) AS y1, y - floor(y) AS fy, floor(x)::INT AS x0, least(floor(x)::INT + 1, 7) AS x1, x - floor(x) AS fx FROM p),
e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT vec_id, spot::INT AS "at", round((v[y0 * 8 + x0 + 1] * (1 - fy) + v[y1 * 8 + x0 + 1] * fy) * (1 - fx) + (v[y0 * 8 + x1 + 1] * (1 - fy) + v[y1 * 8 + x1 + 1] * fy) * fx, 6) + 0 AS value FROM e, c""",
    "feature_cache": "SELECT doc_id, length(text) AS chars, doc_id IN (SELECT doc_id FROM labels) AS was_there FROM documents",
    "sink_header": oracles.ORACLES["rule_histogram"].join(["SELECT (sum(n) OVER ())::BIGINT AS num_samples, rule, n FROM (", ")"]),
    "scheduled_mix": _MIX, "sampler_ranks": _SAMPLER,
}
