"""C7: price catalogue, keys and errors; small tables and part names as model ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import models as mf
from ..operators import catalog
from ..sources.tables import USAGE_SQL, read, usage_events
from .registry import query

#: ids of models made of parts: what a provider's begin with, and endings of which some are no chat models, unstable or small
FAMILIES = (("openai", "gpt-"), ("anthropic", "claude-"), ("gemini", "gemini-"), ("other", ""))
ENDINGS = ("", "-preview", "-embed", "-instruct", "-3b", "-vl", "-image")


def _chosen(names, n):
    return F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))


def _models(spark, sf_dir):
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    size = F.col("p_size").cast("string")
    name = F.concat(_chosen([f for _, f in FAMILIES], k), (k % 5 + 1).cast("string"), F.lit("."), size, F.lit("-p"), k.cast("string"), _chosen(ENDINGS, F.col("p_size")))
    return p.select("p_partkey", _chosen([n for n, _ in FAMILIES], k).alias("provider"), name.alias("model"), (F.col("p_size") % 4).cast("double").alias("input"), (F.col("p_size") % 3).cast("double").alias("output"))


_LIST = lambda names: "['" + "', '".join(names) + "']"
MODELS_SQL = f"""models as (select p_partkey, {_LIST(n for n, _ in FAMILIES)}[p_partkey % 4 + 1] as provider,
  {_LIST(f for _, f in FAMILIES)}[p_partkey % 4 + 1] || (p_partkey % 5 + 1) || '.' || p_size || '-p' || p_partkey || {_LIST(ENDINGS)}[p_size % {len(ENDINGS)} + 1] as model, cast(p_size % 4 as double) as input, cast(p_size % 3 as double) as output from part)"""
TEXT_SQL = "not regexp_matches(model, 'embed|-image') and (provider not in ('openai', 'gemini') or not regexp_matches(model, 'image|-instruct'))"


@query(f"""with {MODELS_SQL}, m as (select *, regexp_matches(model, '-3b$') as demoted, regexp_matches(model, 'preview') as unstable, cast(regexp_extract(model, '(\\d+(?:[.-]\\d+)?)', 1) as double) as version from models where {TEXT_SQL}),
r as (select *, row_number() over (order by demoted, input * 0.75 + output * 0.25, unstable, version desc, model) as rank from m)
select cast(rank as int) as rank, provider, model from r where rank <= 100""")
def rank_models(spark, sf_dir):
    """The first hundred of the chat models among ids made of parts."""
    return catalog.rank(_models(spark, sf_dir).drop("p_partkey"), native=False)


@query(f"with {MODELS_SQL} select p_partkey, provider, model, {TEXT_SQL} as chats from models")
def text_models(spark, sf_dir):
    """Whether a model chats, by its provider and its id."""
    return _models(spark, sf_dir).select("p_partkey", "provider", "model", mf.is_text_model(F.col("provider"), F.col("model")).alias("chats"))


KEYS = (("small", 1.0, 2.0), ("small gizmo", 3.0, 4.0), ("red", 5.0, 6.0), ("red widget", 7.0, 8.0), ("hot gear", 9.0, 10.0), ("b", 0.5, 0.5))
KEYS_SQL = "keys as (select * from (values " + ", ".join(f"('{k}', {i}::double, {o}::double)" for k, i, o in KEYS) + ") as t(key, input, output))"


@query(f"with {KEYS_SQL}, p as (select p.*, k.*, row_number() over (partition by p_partkey order by length(k.key) desc) as r from part p left join keys k on starts_with(p_name, k.key) and (length(p_name) = length(k.key) or substr(p_name, length(k.key) + 1, 1) = ' ')) select p_partkey, p_name, coalesce(key, '-') as key, coalesce(input, -1) as input from p where r = 1")
def price_prefix(spark, sf_dir):
    table = spark.createDataFrame(KEYS, "key string, input double, output double")
    out = catalog.longest_prefix(read(spark, sf_dir, "part").select("p_partkey", "p_name"), table, "p_name", "key", boundary="[ ]")
    return out.select("p_partkey", "p_name", F.coalesce("key", F.lit("-")).alias("key"), F.coalesce("input", F.lit(-1.0)).alias("input"))


@query(f"with {USAGE_SQL} select id, cast(floor(case provider when 'p0' then 1.0::double when 'p1' then 2.5::double else 0.15::double end * input_tokens + case provider when 'p0' then 5.0::double when 'p1' then 10.0::double else 0.6::double end * output_tokens + 0.5) as bigint) as micro_usd from usage")
def usage_cost(spark, sf_dir):
    prices = spark.createDataFrame([("p0", 1.0, 5.0), ("p1", 2.5, 10.0), ("p2", 0.15, 0.6)], "provider string, input double, output double")
    u = usage_events(spark, sf_dir).join(prices, "provider")
    return u.select("id", mf.cost_micro_usd(F.col("input"), F.col("output"), F.col("input_tokens"), F.col("output_tokens")).alias("micro_usd"))


@query("""select p_partkey, case when p_name like '%mini%' or p_name like '%nano%' or p_name like '%small%' or p_name like '%lite%' or p_name like '%flash%' or p_name like '%instant%' or p_name like '%turbo%' or p_name like '%haiku%' then 0.1::double when p_name like '%medium%' or p_name like '%air%' then 0.3::double when p_name like '%plus%' then 0.6::double when regexp_matches(p_name, 'large|max|pro|opus') then 2.0::double else 0.5::double end as input from part""")
def tier_price(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", mf.tier_price(F.lit("other"), F.col("p_name")).alias("x"))
    return p.select("p_partkey", F.col("x.input").alias("input"))


@query("""select event_id, case when k in (1, 3) or event_type = 'error' then 'auth' when k = 2 or event_type = 'purchase' then 'quota' when k = 4 then 'model' when k = 29 then 'rate' else 'other' end as kind
from (select *, cast(json_extract_string(props, '$.k') as int) as k from events)""")
def error_kinds(spark, sf_dir):
    """Status 400 + k, with a message for two of the event types."""
    e = read(spark, sf_dir, "events").withColumn("status", F.get_json_object("props", "$.k").cast("int") + 400)
    message = F.when(F.col("event_type") == "error", "Invalid API key given").when(F.col("event_type") == "purchase", "see Billing").otherwise("")
    return e.select("event_id", mf.error_kind(F.col("status"), message).alias("kind"))


@query("""select c_custkey, case c_custkey % 4 when 0 then 'anthropic' when 1 then 'deepseek,qwen' when 2 then 'mistral,deepinfra' else '' end as providers, right(md5(cast(c_custkey as varchar)), 4) as hint from customer""")
def key_providers(spark, sf_dir):
    """Keys made of each customer's MD5 in four forms; the last one is too short."""
    c = read(spark, sf_dir, "customer")
    h = F.md5(F.col("c_custkey").cast("string"))
    form = F.col("c_custkey") % 4
    key = F.when(form == 0, F.concat(F.lit("sk-ant-"), h)).when(form == 1, F.concat(F.lit(" sk-"), h)).when(form == 2, h).otherwise(F.right(h, F.lit(10)))
    return c.select("c_custkey", F.array_join(mf.key_providers(key), ",").alias("providers"), mf.key_hint(key).alias("hint"))


@query("""with p as (select *, p_retailprice / 1e9 as cost from part where p_size % 3 <> 0 and p_size % 5 <> 0 and p_size % 7 <> 0)
select 'm' || p_partkey as model, floor(cost * 1e6 * 1e6 + 0.5) / 1e6 as input, floor(cost * 4 * 1e6 * 1e6 + 0.5) / 1e6 as output, p_size % 2 = 0 as vision from p""")
def price_file(spark, sf_dir):
    """Price files of fifty parts each, in which some do not chat, or lack a price, or have a negative one."""
    size, cost = F.col("p_size"), F.col("p_retailprice") / 1e9
    sound = F.when(size % 7 == 0, -cost).when(size % 5 != 0, cost)
    entry = F.struct(
        F.when(size % 3 == 0, "embedding").otherwise("chat").alias("mode"), sound.alias("input_cost_per_token"), (cost * 4).alias("output_cost_per_token"), (size % 2 == 0).alias("supports_vision")
    )
    key = F.concat(F.when(F.col("p_partkey") % 2 == 0, "maker/m").otherwise("m"), F.col("p_partkey").cast("string"))
    files = read(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 50)).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key, entry)))).alias("json"))
    return catalog.price_file(files)


@query("""with s as (select c_custkey, case when c_mktsegment = 'BUILDING' then 0 else 1 end as pref, c_nationkey from customer), r as (select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by pref, c_custkey) as n from s) select c_nationkey, c_custkey from r where n <= 3""")
def candidate_order(spark, sf_dir):
    """Preferred ones first, then by id; three a group."""
    from pyspark.sql import Window

    order = Window.partitionBy("c_nationkey").orderBy(F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(1), "c_custkey")
    return read(spark, sf_dir, "customer").withColumn("n", F.row_number().over(order)).filter("n <= 3").select("c_nationkey", "c_custkey")


IMAGE_IDS = (("openai", "gpt-4o-mini", True), ("openai", "o1-mini", False), ("openai", "gpt-3.5", False), ("anthropic", "claude-3-x", True), ("anthropic", "claude-2", False), ("gemini", "gemini-1", True), ("xai", "grok-4-fast", True), ("xai", "grok-2", False), ("other", "qwen-vl-7b", True), ("other", "plain-7b", False))


@query("""with m(k, provider, model, guess) as (values """ + ", ".join(f"({k}, '{p}', '{m}', {str(x).lower()})" for k, (p, m, x) in enumerate(IMAGE_IDS)) + f""")
select c_custkey, provider, model, case c_custkey % 3 when 0 then true when 1 then false else guess end as images from customer join m on k = c_custkey % {len(IMAGE_IDS)}""")
def image_models(spark, sf_dir):
    """Whether a model reads images: the catalogue's flag, else by its name."""
    c = read(spark, sf_dir, "customer")
    ids = F.array(*(F.struct(F.lit(p).alias("provider"), F.lit(m).alias("model")) for p, m, _ in IMAGE_IDS))
    x = F.element_at(ids, (F.col("c_custkey") % len(IMAGE_IDS) + 1).cast("int"))
    listed = F.when(F.col("c_custkey") % 3 == 0, True).when(F.col("c_custkey") % 3 == 1, False)
    rows = c.select("c_custkey", x["provider"].alias("provider"), x["model"].alias("model"), listed.alias("listed"))
    return rows.select("c_custkey", "provider", "model", mf.supports_images(F.col("provider"), F.col("model"), F.col("listed")).alias("images"))
