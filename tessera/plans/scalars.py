"""Scalar functions and nested documents on the test data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions import text as tx
from ..operators import structure as st
from ..sources import files
from ..sources.tables import read
from .registry import query

HEX = "md5(cast(c_custkey as varchar))"
FORM = f"substr({HEX}, 1, 8) || '-' || substr({HEX}, 9, 4) || '-' || substr({HEX}, 13, 4) || '-' || substr({HEX}, 17, 4) || '-' || substr({HEX}, 21, 12)"


@query(f"select c_custkey, regexp_full_match(case when c_custkey % 3 = 0 then {FORM} || 'x' when c_custkey % 3 = 1 then upper({FORM}) else {HEX} end, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}') as ok from customer")
def uuid_check(spark, sf_dir):
    h = F.md5(F.col("c_custkey").cast("string"))
    form = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    kind = F.col("c_custkey") % 3
    text = F.when(kind == 0, F.concat(form, F.lit("x"))).when(kind == 1, F.upper(form)).otherwise(h)
    return read(spark, sf_dir, "customer").select("c_custkey", sc.is_uuid(text).alias("ok"))


@query("select event_id, case when event_id % 3 < 2 then strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') else '-' end as t from events")
def date_coercion(spark, sf_dir):
    """Times as milliseconds, as ISO text, and as something else."""
    e = read(spark, sf_dir, "events")
    form = F.col("event_id") % 3
    text = F.when(form == 0, F.unix_millis(F.col("ts").cast("timestamp")).cast("string")).when(form == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")
    return e.select("event_id", F.coalesce(F.date_format(sc.to_time(text), "yyyy-MM-dd HH:mm:ss"), F.lit("-")).alias("t"))


@query("select event_id, coalesce(cast(json_extract_string(props, '$.k') as int), -1) as k from events")
def fenced_json(spark, sf_dir):
    """The JSON of each event inside a fenced answer with words around it."""
    e = read(spark, sf_dir, "events")
    answer = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```\nDone."))
    return e.select("event_id", F.coalesce(sc.json_of(answer, "k int").getField("k"), F.lit(-1)).alias("k"))


@query("select c_custkey, repeat('*', cast(length(c_name) - 4 as int)) || right(c_name, 4) as masked from customer")
def masking(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", sc.masked(F.col("c_name")).alias("masked"))


@query("select '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [' || upper(event_type) || '] [u' || user_id || '] v' as value from events")
def log_sink(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return files.log_lines(e.select("ts", F.col("event_type").alias("level"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("stage"), F.lit("v").alias("message")))


@query("""with c as (select r_regionkey, r_name, list(n_name order by n_nationkey) as s from region join nation on n_regionkey = r_regionkey group by 1, 2)
select r_name || ' > ' || unnest(s) as title from c""")
def flatten_chapters(spark, sf_dir):
    n = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("sections"))
    r = read(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    nested = r.agg(F.collect_list(F.struct(F.col("r_name").alias("title"), "sections")).alias("chapters"))
    return st.flatten_chapters(nested).select("title")


@query("select conv_id, md5(string_agg(regexp_replace(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '\\A\\s+', ''), '\\s+\\z', ''), chr(10) order by turn)) as digest from conversations group by 1")
def nested_document(spark, sf_dir):
    """Documents to pages, sentences and words, and back to text."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(tx.sentences(F.col("text"))).alias("s", "sentence"))
    words = c.select("conv_id", "turn", "s", F.posexplode(tx.words(F.col("sentence"))).alias("w", "word"))
    sentence = words.groupBy("conv_id", "turn", "s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w", "word"))), lambda x: x["word"]), " ").alias("t"))
    page = sentence.groupBy("conv_id", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "t"))), lambda x: x["t"]), " ").alias("t"))
    return page.groupBy("conv_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), "\n")).alias("digest"))
