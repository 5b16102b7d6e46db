"""The numbered queries of the training-data operators, with production parameters, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weatherlake.llm import bpe, centroids, chat, exact_dedup, latent, ngram_join, ngram_lm, packing, perplexity, phrases, sharding, suffix_dedup, toxicity
from weatherlake.llm.common import table
from weatherlake.llm.labelled import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.byte_shards(table(spark, sf_dir, "documents"), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), size=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, sf_dir, "documents"), keep="largest").drop("_row")


SQL["op4_exact_dedup"] = """
with folded as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents
)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = max(doc_id) over g as kept, text_sha256
from folded window g as (partition by text_sha256)
"""


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, tokenizer_path()).drop("text")
    return bpe.decode(ids, tokenizer_path()).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.examples(turns))


SQL["op8_chat"] = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized as (
  select *, length('<|im_start|>') + length(role) + 1
            + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + length('<|im_end|>') + 1 as chars,
         row_number() over (partition by conv_id order by turn desc) as back
  from turns
), summed as (
  select *, sum(chars) over (partition by conv_id order by turn) as so_far from sized
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(so_far) filter (role = 'assistant' or back = 1) as bigint) as formatted_chars
from summed group by conv_id
"""


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.rules(table(spark, sf_dir, "documents"))


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = latent.fit(docs, table(spark, sf_dir, "labels"))
    scored = latent.score(docs, model).drop("text")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model).drop("text")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "passages")


@query
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(table(spark, sf_dir, "documents"))


@query
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.similar(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


@query
def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.find_repeats(table(spark, sf_dir, "documents"), length=400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.clusters(table(spark, sf_dir, "embeddings"), k=16, rounds=3, size=64, scale=64, seed=1)
    return found.withColumn("centroid_sha256", F.sha2(F.array_join("centroid", ","), 256)).drop("centroid")


def _centroid_sql(k: int = 16, rounds: int = 3, size: int = 64) -> str:
    dist = "list_sum(list_transform(generate_series(1, {s}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))".format(s=size)
    steps = [
        f"""v as materialized (
  select vec_id, list_transform(embedding, lambda e: cast(floor(64 * cast(e as double)) as bigint)) as x
  from embeddings where len(embedding) = {size} and list_count(list_filter(embedding, lambda e: isfinite(e))) = {size}
), c0 as materialized (
  select cast(row_number() over (order by sha256('1:' || vec_id)) - 1 as int) as c, x
  from v qualify row_number() over (order by sha256('1:' || vec_id)) <= {k}
)"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} as materialized (
  select v.vec_id, any_value(v.x) as x, min(({dist}, c.c)) as best from v, c{r} c group by v.vec_id
)"""
        )
        if r < rounds:
            steps.append(
                f"""m{r} as (
  select c, i, cast(floor_div as bigint) as y from (
    select best[2] as c, i, sum(x[i]) as s, count(*) as n,
           (s - (((s % n) + n) % n)) // n as floor_div
    from a{r}, generate_series(1, {size}) g(i) group by best[2], i)
), c{r + 1} as materialized (
  select c{r}.c, coalesce(any_value(n.x), any_value(c{r}.x)) as x
  from c{r} left join (select c, list(y order by i) as x from m{r} group by c) n on n.c = c{r}.c group by c{r}.c
)"""
            )
    return f"""
with {", ".join(steps)}
select vec_id, cast(best[2] as int) as cluster, cast(best[1] as bigint) as distance,
       cast(sum(best[1]) over (partition by best[2]) as bigint) as cluster_inertia,
       cast(sum(best[1]) over () as bigint) as inertia, sha256(array_to_string(c{rounds}.x, ',')) as centroid_sha256
from a{rounds} join c{rounds} on c{rounds}.c = best[2]
"""


SQL["op13_centroid_clusters"] = _centroid_sql()


@query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"), sizes=3, threshold=10, inside=50, top=2000)


SQL["op11_phrase_collocations"] = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), words as materialized (
  select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces
), grams as (
  select lang, size, unnest(list_transform(generate_series(1, len(w) - size + 1), lambda i: array_to_string(w[i:i + size - 1], ' '))) as g
  from words, generate_series(1, 3) s(size) where len(w) >= size
), f as materialized (
  select lang, g, size, count(*) as n from grams group by all
), totals as (
  select lang, cast(sum(n) as bigint) as n from f where size = 1 group by lang
), cand as materialized (
  select lang, g, size, n as a, string_split(g, ' ') as w from f where size >= 2 and n >= 10
), inner_of as (
  select lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as g, a from cand where size = 3
), longest as (
  select lang, g, max(a) as longest from inner_of group by all
), kept as (
  select c.* from cand c left join longest x on x.lang = c.lang and x.g = c.g
  where x.longest is null or 100 * x.longest < 50 * c.a
), cuts as (
  select *, unnest(generate_series(1, size - 1)) as k from kept
), scored as (
  select c.lang, c.g, c.a, c.k, p.n as l, q.n as r,
         (1000000::hugeint * c.a * c.a) // (p.n::hugeint * q.n) as score
  from cuts c join f p on p.lang = c.lang and p.g = array_to_string(c.w[1:c.k], ' ')
              join f q on q.lang = c.lang and q.g = array_to_string(c.w[c.k + 1:c.size], ' ')
), worst as (
  select * from scored qualify row_number() over (partition by lang, g order by score, k) = 1
)
select w.lang, row_number() over o as rank, w.g as phrase, w.a, w.l, w.r, t.n, cast(w.score as bigint) as score
from worst w join totals t on t.lang = w.lang
window o as (partition by w.lang order by w.score desc, w.a desc, w.g)
qualify row_number() over o <= 2000
"""
