"""Queries over the provided tables, each with the same result in SQL for an independent engine.

Tables stand in for metadata: documents for texts, labels for availability and
gold values, order priorities (of which one means "not specified") for labels
with a natural missing spelling, part names for multi-valued cells.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon, missing, stats, tokens
from ..operators import derive, evaluate, fuse, lexicons, profile, retrieve, search, vectors, windows
from .scratch import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
UNSPECIFIED = ("4-not specified",)


def query(sql: str | None):
    """Register a query, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- two versions of the orders table -----------------------------------------------------------

GOLD = "select o_orderkey as key, o_orderpriority as priority, o_orderstatus as status from orders"
PRED = """select o_orderkey as key, case when o_orderkey % 7 = 0 then '4-NOT SPECIFIED' when o_orderkey % 5 = 0 then '1-URGENT' else o_orderpriority end as priority,
    case when o_orderkey % 11 = 0 then null when o_orderkey % 13 = 0 then ' n/a ' else o_orderstatus end as status from orders"""
LONG = f"""g as ({GOLD}), p as ({PRED}),
lf as (select g.key, 'priority' field, g.priority gold, p.priority pred from g left join p on g.key = p.key
    union all select g.key, 'status', g.status, p.status from g left join p on g.key = p.key),
fl as (select *, coalesce(lower(trim(gold)) not in ('', 'n/a', 'na', 'none', 'null', 'unk', 'unknown', 'not available', 'not applicable', 'not reported', 'nr', 'n/r', '4-not specified'), false) a,
    coalesce(lower(trim(pred)) not in ('', 'n/a', 'na', 'none', 'null', 'unk', 'unknown', 'not available', 'not applicable', 'not reported', 'nr', 'n/r', '4-not specified'), false) b from lf)"""


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The gold and the predicted version."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    gold = o.select(k.alias("key"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    pred = o.select(
        k.alias("key"),
        F.when(k % 7 == 0, "4-NOT SPECIFIED").when(k % 5 == 0, "1-URGENT").otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, " n/a ").otherwise(F.col("o_orderstatus")).alias("status"),
    )
    return gold, pred


def long_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.pairs(*versions(spark, sf_dir), "key", ["priority", "status"])


SCORES = """n as (select field, count(*) total_rows, count_if(a) available_gold, count_if(b) pred_present, count_if(a and b) tp, count_if(not a and b) fp,
    count_if(a and not b) fn, count_if(a and b and coalesce({same}, false)) correct from fl group by field),
r as (select *, coalesce(tp::double / nullif(tp + fp, 0), 0) precision_, coalesce(tp::double / nullif(tp + fn, 0), 0) recall_ from n)
select field, total_rows, available_gold::bigint available_gold, pred_present::bigint pred_present, tp::bigint tp, fp::bigint fp, fn::bigint fn, correct::bigint correct,
    round(precision_, 6) "precision", round(recall_, 6) recall, round(coalesce(2 * precision_ * recall_ / nullif(precision_ + recall_, 0), 0), 6) f1,
    round(coalesce(correct::double / nullif(available_gold, 0), 0), 6) coverage_ceiling, round(coalesce(correct::double / nullif(total_rows, 0), 0), 6) yield_end_to_end from r"""


@query(f"with {LONG}, {SCORES.format(same='gold = pred')}")
def two_stage_eval_exact(spark, sf_dir):
    """Availability, then exact correctness, for each field."""
    return evaluate.two_stage(long_form(spark, sf_dir), extra=UNSPECIFIED)


PARTS = """fl as (select p_partkey key, 'name' field, list_sort(list_distinct(string_split(lower(p_name), ' '))) g,
    list_sort(list_distinct(case when p_partkey % 9 = 0 then [lower(p_type)] else string_split(lower(p_name), ' ') end)) p, true a, p_partkey % 6 <> 0 b from part)"""


@query(f"with {PARTS}, {SCORES.format(same='g = p')}")
def two_stage_eval_tokens(spark, sf_dir):
    """Availability, then correctness of token sets: order, case and repeats don't matter."""
    p = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    gold = p.select(F.col("p_partkey").alias("key"), F.array_join(words, ", ").alias("name"))
    other = F.concat(F.array_join(F.reverse(words), " + "), F.lit("; "), F.upper(F.element_at(words, 1)))
    pred = p.select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 6 == 0, " NR ").when(F.col("p_partkey") % 9 == 0, F.col("p_type")).otherwise(other).alias("name"))
    return evaluate.two_stage(evaluate.pairs(gold, pred, "key", ["name"]), tokens=True)


@query(f"with {LONG} select key, field, gold, pred from fl where a and b and gold <> pred")
def mismatches(spark, sf_dir):
    """Available values that are predicted wrongly."""
    return evaluate.mismatches(long_form(spark, sf_dir), extra=UNSPECIFIED)


@query(f"with {LONG} select key, field, gold, pred from fl where a and not b")
def missing_predictions(spark, sf_dir):
    """Available values without a prediction."""
    return evaluate.missing_predictions(long_form(spark, sf_dir), extra=UNSPECIFIED)


@query(f"with {LONG} select field, count(*) wrong, count_if(gold like '%,%' or pred like '%,%' or gold like '%+%' or pred like '%+%')::bigint several_items from fl where a and b and gold <> pred group by field")
def error_taxonomy(spark, sf_dir):
    """Mismatches with several items on a side."""
    return evaluate.error_taxonomy(evaluate.mismatches(long_form(spark, sf_dir), extra=UNSPECIFIED))


@query(f"""with {LONG}, s as (select field, nullif(nullif(lower(trim(gold)), ''), 'not reported') g, nullif(nullif(lower(trim(pred)), ''), 'not reported') p from lf),
n as (select coalesce(field, '__MICRO__') field, count_if(g is not null and coalesce(g = p, false)) tp, count_if(p is not null and coalesce(g <> p, true)) fp,
    count_if(g is not null and coalesce(g <> p, true)) fn from (select field, case when g like '%n/a%' then 'a,n' else g end g, case when p like '%n/a%' then 'a,n' else p end p from s) group by rollup (field)),
r as (select *, coalesce(tp::double / nullif(tp + fp, 0), 1) precision_, coalesce(tp::double / nullif(tp + fn, 0), 1) recall_ from n)
select field, tp::bigint tp, fp::bigint fp, fn::bigint fn, round(precision_, 6) "precision", round(recall_, 6) recall, round(coalesce(2 * precision_ * recall_ / nullif(precision_ + recall_, 0), 0), 6) f1 from r""")
def gold_prf_micro(spark, sf_dir):
    """Precision, recall and F1 of label sets, with a total."""
    return evaluate.set_scores(long_form(spark, sf_dir))


COVER = f"""with {LONG}, c as (select field, coalesce(gold not in ('', 'Not reported', '4-NOT SPECIFIED'), false) x, coalesce(pred not in ('', 'Not reported', '4-NOT SPECIFIED'), false) y from lf)"""


@query(f"{COVER} select coalesce(field, 'overall') field, count(*) cells, count_if(y)::bigint filled, round(count_if(y)::double / count(*), 6) coverage from c group by rollup (field)")
def coverage_by_column(spark, sf_dir):
    """Filled share of each field and over all."""
    return evaluate.coverage(versions(spark, sf_dir)[1], "key", ["priority", "status"], extra=("4-NOT SPECIFIED",))


@query(f"""with p as ({PRED}) select key, (coalesce(priority not in ('', 'Not reported', '4-NOT SPECIFIED'), false)::int + coalesce(status not in ('', 'Not reported', '4-NOT SPECIFIED'), false)::int)::bigint filled,
    (coalesce(priority not in ('', 'Not reported', '4-NOT SPECIFIED'), false)::int + coalesce(status not in ('', 'Not reported', '4-NOT SPECIFIED'), false)::int) / 2.0::double coverage from p""")
def coverage_per_row(spark, sf_dir):
    """Filled share of each row."""
    return evaluate.coverage_of_rows(versions(spark, sf_dir)[1], "key", ["priority", "status"], extra=("4-NOT SPECIFIED",))


@query(f"""{COVER}, d as (select coalesce(field, 'overall') field, round(count_if(x)::double / count(*), 6) before, round(count_if(y)::double / count(*), 6) after from c group by rollup (field))
select field, before, after, round(after - before, 6) delta from d""")
def coverage_delta(spark, sf_dir):
    """The change of coverage between two versions."""
    a, b = (evaluate.coverage(v, "key", ["priority", "status"], extra=("4-NOT SPECIFIED",)) for v in versions(spark, sf_dir))
    return evaluate.coverage_delta(a, b)


@query(f"""with {LONG}, m as (select field, gold, pred, coalesce(lower(trim(gold)) in ('', 'not reported', 'nan', 'none', 'null', 'na', 'n/a', '-', '4-not specified'), true) a,
    coalesce(lower(trim(pred)) in ('', 'not reported', 'nan', 'none', 'null', 'na', 'n/a', '-', '4-not specified'), true) b from lf)
select field, count(*) cells, count_if(a)::bigint missing_before, count_if(b)::bigint missing_after, count(distinct gold) distinct_before, count(distinct pred) distinct_after,
    count_if(a and not b)::bigint improved, count_if(not a and b)::bigint degraded from m group by field""")
def version_compare(spark, sf_dir):
    """Missing, distinct, improved and degraded cells between two versions."""
    return evaluate.compare_versions(long_form(spark, sf_dir), extra=UNSPECIFIED)


# --- availability: labels as mask, two predictions over documents --------------------------------

AVAIL = """d as (select l.doc_id, l.quality, l.toxic, d.lang, d.source from labels l join documents d using (doc_id)),
lf as (select 'quality' field, quality::varchar mask, case when doc_id % 3 = 0 then '—' else source end base, case when doc_id % 5 = 0 then ' Not Reported' else source end target from d
    union all select 'toxic', toxic::varchar, case when lang = 'en' then null else lang end, case when doc_id % 4 = 0 then 'NULL' else lang end from d)"""


def availability_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    i = F.col("doc_id")
    rows = F.array(
        F.struct(F.lit("quality").alias("field"), F.col("quality").cast("string").alias("mask"), F.when(i % 3 == 0, "—").otherwise(F.col("source")).alias("base"), F.when(i % 5 == 0, " Not Reported").otherwise(F.col("source")).alias("target")),
        F.struct(F.lit("toxic").alias("field"), F.col("toxic").cast("string").alias("mask"), F.when(F.col("lang") != "en", F.col("lang")).alias("base"), F.when(i % 4 == 0, "NULL").otherwise(F.col("lang")).alias("target")),
    )
    return d.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")


@query(f"""with {AVAIL}, f as (select field, mask::double > 0 a, coalesce(lower(trim(base)) not in ('', 'not reported', 'n/a', 'na', 'none', 'null', '-', '—', '–'), false) x,
    coalesce(lower(trim(target)) not in ('', 'not reported', 'n/a', 'na', 'none', 'null', '-', '—', '–'), false) y from lf),
n as (select field, count(*) n, count_if(a)::bigint avail_n, count_if(x)::bigint base_filled, count_if(y)::bigint target_filled, count_if(a and x)::bigint base_hit, count_if(a and y)::bigint target_hit,
    count_if(a and x and not y)::bigint lost, count_if(a and not x and y)::bigint won from f group by field),
e as (select field, 2 * sum(exp(lgamma(lost + won + 1) - lgamma(i + 1) - lgamma(lost + won - i + 1) - (lost + won) * ln(2.0::double))) p
    from (select *, unnest(range(0, least(lost, won) + 1)) i from n where lost + won > 0) group by field),
w as (select *, target_hit::double / avail_n ph, avail_n::double m from n)
select field, n, avail_n, base_filled, target_filled, base_hit, target_hit, lost, won, round(target_filled::double / n - base_filled::double / n, 6) apparent_delta,
    round(base_hit::double / avail_n, 6) adjusted_base, round(ph, 6) adjusted_target, round((avail_n - target_hit)::double / avail_n, 6) miss_rate,
    round(greatest(0, (ph + 1.96 * 1.96 / (2 * m)) / (1 + 1.96 * 1.96 / m) - 1.96 * sqrt((ph * (1 - ph) + 1.96 * 1.96 / (4 * m)) / m) / (1 + 1.96 * 1.96 / m)), 6) ci_low,
    round(least(1, (ph + 1.96 * 1.96 / (2 * m)) / (1 + 1.96 * 1.96 / m) + 1.96 * sqrt((ph * (1 - ph) + 1.96 * 1.96 / (4 * m)) / m) / (1 + 1.96 * 1.96 / m)), 6) ci_high,
    round(least(1, e.p), 6) p_value from w left join e using (field)""")
def availability_compare(spark, sf_dir):
    """Coverage of two predictions, apparent and where available, with an interval and a paired test."""
    return evaluate.availability_comparison(availability_long(spark, sf_dir))


@query(f"with {AVAIL} select count(*) n, field from lf where mask = '1' and coalesce(lower(trim(target)) in ('', 'n/a', 'na', 'none', 'null', 'unk', 'unknown', 'not available', 'not applicable', 'not reported', 'nr', 'n/r'), true) group by field")
def misses(spark, sf_dir):
    """Cells that exist by the mask and are missing in the prediction, by field."""
    return evaluate.misses(availability_long(spark, sf_dir).withColumnRenamed("target", "pred")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


@query("""with n as (select quality, count(*) n, sum(toxic)::bigint k from labels group by quality), w as (select *, k::double / n ph from n)
select quality, k, n, round(greatest(0, (ph + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt((ph * (1 - ph) + 1.96 * 1.96 / (4 * n)) / n) / (1 + 1.96 * 1.96 / n)), 6) ci_low,
    round(least(1, (ph + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt((ph * (1 - ph) + 1.96 * 1.96 / (4 * n)) / n) / (1 + 1.96 * 1.96 / n)), 6) ci_high from w""")
def wilson_interval(spark, sf_dir):
    """The interval of the toxic share by quality."""
    n = table(spark, sf_dir, "labels").groupBy("quality").agg(F.sum("toxic").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return n.select("quality", "k", "n", F.round(low, 6).alias("ci_low"), F.round(high, 6).alias("ci_high"))


# --- fusion --------------------------------------------------------------------------------------


@query("""with v as (select p_brand key, p_type "value", count(*) strength, min(p_partkey) f from part group by 1, 2)
select key, "value", strength from v qualify row_number() over (partition by key order by strength desc, f) = 1""")
def vote_fuse(spark, sf_dir):
    """The most common type of each brand, first seen on ties."""
    return fuse.vote(table(spark, sf_dir, "part"), "p_brand", "p_type", "p_partkey")


@query("""with t as (select p_brand key, p_partkey, unnest(list_distinct(string_split(p_name, ' '))) token from part), n as (select key, token, count(*) n from t group by 1, 2)
select key, string_agg(token, ',' order by token) tokens, max(n) strength from n group by key""")
def union_fuse(spark, sf_dir):
    """All words in a brand's names."""
    out = fuse.union(table(spark, sf_dir, "part"), "p_brand", F.split("p_name", " "))
    return out.withColumn("tokens", F.array_join("tokens", ","))


@query("""with v as (select p_brand, p_type v, count(*) strength, min(p_partkey) f from part group by 1, 2), b as (select * from v qualify row_number() over (partition by p_brand order by strength desc, f) = 1),
n as (select p_brand, p_name token, count(*) n from part group by 1, 2)
select b.p_brand key, v p_type, strength p_type__strength, string_agg(token, ', ' order by token) p_name, max(n) p_name__strength from b join n using (p_brand) group by 1, 2, 3""")
def fuse_table(spark, sf_dir):
    """One row for each brand, its type voted and its names united."""
    return fuse.fuse_table(table(spark, sf_dir, "part"), "p_brand", ["p_type"], ["p_name"], "p_partkey")


@query("""select l_orderkey, l_linenumber, l_returnflag, l_quantity from lineitem
qualify row_number() over (partition by l_orderkey order by (l_returnflag <> 'N')::int + (l_linestatus <> 'O')::int desc, l_quantity > 40 desc, l_linenumber, l_partkey, l_suppkey) = 1""")
def best_per_key(spark, sf_dir):
    """The fullest line of each order, large quantities first on ties, then the first."""
    d = table(spark, sf_dir, "lineitem").withColumn("ord", F.col("l_linenumber"))
    score = F.expr("int(l_returnflag <> 'N') + int(l_linestatus <> 'O')")
    tie = [score, F.expr("int(l_quantity > 40)"), -F.col("l_linenumber"), -F.col("l_partkey")]
    return fuse.best_row(d, F.col("l_orderkey"), tie, "l_suppkey").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")


SEED = """with s as (select doc_id, case when quality = 1 then 'good' else '' end prior from labels),
e as (select doc_id, case when doc_id % 2 = 0 or lang = 'fr' then lang when doc_id % 5 = 0 then ' ' end new, doc_id % 3 = 0 strong from documents)
select coalesce(s.doc_id, e.doc_id) key, case when trim(coalesce(new, '')) <> '' and {rule} then new else prior end "value" from s full join e on s.doc_id = e.doc_id"""


def _seed(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    seed = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("").alias("v"))
    value = F.expr("case when doc_id % 2 = 0 or lang = 'fr' then lang when doc_id % 5 = 0 then ' ' end")  # evidence without a value, too
    found = table(spark, sf_dir, "documents").select("doc_id", value.alias("v"), (F.col("doc_id") % 3 == 0).alias("strong"))
    return fuse.seed_merge(seed, found, "doc_id", "v", "strong", strict)


@query(SEED.format(rule="(strong or coalesce(prior, '') = '')"))
def seed_merge_strict(spark, sf_dir):
    """Evidence merged into a seed; weak evidence fills only what is missing."""
    return _seed(spark, sf_dir, True)


@query(SEED.format(rule="true"))
def seed_merge_hybrid(spark, sf_dir):
    """Evidence merged into a seed; evidence always counts."""
    return _seed(spark, sf_dir, False)


# --- texts -----------------------------------------------------------------------------------------

CUES = {"license": "license", "link": "https?://", "digits": "[0-9]{3}", "mail": "@"}
CUE_SQL = {"license": "regexp_matches({0}, '(?i)license')", "link": "regexp_matches({0}, '(?i)https?://')", "digits": "regexp_matches({0}, '[0-9][0-9][0-9]')", "mail": "contains({0}, '@')"}
LEX = [(p, n) for n, p in CUES.items()]


@query(f"""select d.doc_id key, greatest(({CUE_SQL['license'].format('d.text')})::int, 0) license, ({CUE_SQL['link'].format('d.text')})::int link, greatest(({CUE_SQL['digits'].format('d.text')})::int, (l.quality is not null)::int) digits,
    ({CUE_SQL['mail'].format('d.text')})::int mail from documents d left join labels l using (doc_id)""")
def mask_build(spark, sf_dir):
    """Availability of each field by cues in the text or filled cells."""
    filled = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("digits"))
    return profile.availability_mask(table(spark, sf_dir, "documents"), "doc_id", "text", CUES, filled)


@query("""select d.doc_id, case when d.doc_id % 3 = 0 then d.lang when l.toxic = 1 then 'Yes' else case when d.doc_id % 3 = 1 then '' end end rag from documents d left join labels l using (doc_id)""")
def mask_backfill(spark, sf_dir):
    """A blank cell filled where the mask says yes."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr("case when doc_id % 3 = 0 then lang when doc_id % 3 = 1 then '' end").alias("rag"))
    mask = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return fuse.backfill(d, mask, "doc_id", "rag", F.when(missing.truthy(F.col("toxic").cast("string"), "listed"), "Yes"))


@query("select doc_id, concat_ws(',', " + ", ".join(f"case when {CUE_SQL[n].format('text')} then '{n}' end" for n in CUES) + ") labels from documents")
def lexicon_hits(spark, sf_dir):
    """All labels of a text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lexicon.all_labels(F.col("text"), LEX), ",").alias("labels"))


@query("select doc_id, coalesce(" + ", ".join(f"case when {CUE_SQL[n].format('text')} then '{n}' end" for n in CUES) + ", 'Not reported') label from documents")
def lexicon_first(spark, sf_dir):
    """The first label of a text."""
    return table(spark, sf_dir, "documents").select("doc_id", lexicon.first_label(F.col("text"), LEX, "Not reported").alias("label"))


@query("""select label, count(*) n from documents join (values ('that|with|this', 'en'), (' que ', 'romance'), (' der | die ', 'de')) x(pattern, label) on regexp_matches("text", pattern) group by label""")
def lexicon_join(spark, sf_dir):
    """Documents with each pattern of a lexicon table."""
    lex = spark.createDataFrame([("that|with|this", "en"), (" que ", "romance"), (" der | die ", "de")], "pattern string, label string")
    return lexicons.join_lexicon(table(spark, sf_dir, "documents"), lex, "text").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("""with w as (select item_id, list_filter(regexp_split_to_array(lower("text"), '[^a-z]+'), lambda x: x <> '')[1:4] ws from benchmark),
p as (select distinct item_id, concat('(?:^|[^a-z])', array_to_string(ws, '[^a-z]+'), '(?:[^a-z]|$)') pattern from w where len(ws) = 4),
u as (select distinct pattern from p), h as (select doc_id, pattern from documents, u where regexp_matches(lower("text"), pattern))
select item_id, count(distinct doc_id) documents, count(*) hits from p join h using (pattern) group by item_id""")
def lexicon_index(spark, sf_dir):
    """A lexicon table with a pattern for the first four words of each benchmark item, against all documents: how many each item meets."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.slice(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != ""), 1, 4).alias("ws"))
    pattern = F.concat(F.lit("(?i)(?:^|[^a-z])"), F.array_join("ws", "[^a-z]+"), F.lit("(?:[^a-z]|$)"))
    patterns = words.where("size(ws) = 4").select("item_id", pattern.alias("pattern")).distinct()
    found = lexicons.join_lexicon(table(spark, sf_dir, "documents").select("doc_id", "text"), patterns, "text")
    return found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("hits"))


@query("""select doc_id, (select string_agg(distinct lower(w), ' ' order by lower(w)) from (select unnest(regexp_extract_all("text", '[0-9][0-9]+')) w)) found from documents""".replace("(select string_agg", "coalesce((select string_agg").replace(" w)) found", " w)), '') found"))
def findall_distinct(spark, sf_dir):
    """All distinct numbers of a text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lexicon.find_all(F.col("text"), "[0-9][0-9]+"), " ").alias("found"))


ANCHORED = """select doc_id, bool_or(regexp_matches(substr(t, greatest(0, at_ - 80) + 1, at_ + 80 - greatest(0, at_ - 80)), ' the |version')) hit from (
    select doc_id, t, (list_sum(list_transform(s[1:i], lambda x: length(x))) + (i - 1) * {n})::bigint at_ from (select doc_id, t, s, unnest(range(1, len(s))) i from (select doc_id, lower(coalesce("text", '')) t, string_split(lower(coalesce("text", '')), '{cue}') s from documents))) group by doc_id"""


@query(f"""with a as ({ANCHORED.format(cue='license', n=7)}), b as ({ANCHORED.format(cue=' with ', n=6)})
select doc_id, case when coalesce(a.hit, false) and coalesce(b.hit, false) then 'license,which' when a.hit then 'license' when b.hit then 'which' else '' end labels from documents left join a using (doc_id) left join b using (doc_id)""")
def anchored_window(spark, sf_dir):
    """Labels whose cue has an anchor within 80 characters, exactly."""
    out = windows.anchored(table(spark, sf_dir, "documents"), "doc_id", "text", {"license": "license", "which": " with "}, " the |version")
    return out.withColumn("labels", F.array_join("labels", ","))


@query("""select doc_id, regexp_matches(lower("text"), 'license[\\s\\S]{0,80}version|version[\\s\\S]{0,80}license') hit from documents""".replace("\\\\", "\\"))
def anchored_window_pattern(spark, sf_dir):
    """The same for one cue and anchor, as one pattern."""
    return windows.within(table(spark, sf_dir, "documents"), "doc_id", "text", "license", "version")


@query("""with p as (select doc_id, length("text") n, string_split(lower("text"), ' que ') s from documents),
g as (select doc_id, n, unnest(range(1, len(s))) i, s from p), a as (select doc_id, n, list_sum(list_transform(s[1:i], lambda x: length(x))) + (i - 1) * 5 at_ from g),
sp as (select doc_id, greatest(0, at_ - 60)::int st, least(n, at_ + 65)::int en from a),
f as (select *, case when st <= max(en) over (partition by doc_id order by st, en rows between unbounded preceding and 1 preceding) + 50 then 0 else 1 end isl from sp),
gr as (select *, sum(isl) over (partition by doc_id order by st, en rows unbounded preceding) grp from f)
select doc_id, grp::bigint grp, min(st) st, max(en) en from gr group by doc_id, grp""")
def merged_windows(spark, sf_dir):
    """Surroundings of a keyword, joined where they nearly touch."""
    return windows.merge_spans(windows.keyword_spans(table(spark, sf_dir, "documents"), "doc_id", "text", " que ", 60))


@query("""with c as (select p_partkey, list_transform(string_split(p_name, ' '), lambda t: case when regexp_matches(t, '^[a-f]') then 'early' when regexp_matches(t, 'e$') then 'ends' else t end) l from part)
select p_partkey, case when l[1] = l[2] then l[1] else concat(l[1], ', ', l[2]) end labels from c""")
def canonicalize_list(spark, sf_dir):
    """Tokens by alias, distinct in order."""
    cell = F.replace("p_name", F.lit(" "), F.lit(" + "))
    return table(spark, sf_dir, "part").select("p_partkey", tokens.canonical(cell, [("^[a-f]", "early"), ("e$", "ends")]).alias("labels"))


@query("""with t as (select p_partkey, list_sort(list_distinct(string_split(lower(p_name), ' '))) s, [lower(p_brand)] b from part),
m as (select *, list_filter(s, lambda x: regexp_matches(x, 'o')) mv from t)
select p_partkey, array_to_string(list_filter(s, lambda x: not regexp_matches(x, 'o')), ',') klass, array_to_string(list_sort(list_distinct(list_concat(b, mv))), ',') task from m""")
def class_task_move(spark, sf_dir):
    """Tokens that belong to another cell go there."""
    left, right = tokens.move_tokens(F.replace("p_name", F.lit(" "), F.lit("; ")), F.col("p_brand"), "o")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(left, ",").alias("klass"), F.array_join(right, ",").alias("task"))


@query("""select o_orderkey, case when v then 'VLM' when vision <> '' and lang = '' then 'Vision-only' when vision = '' and lang <> '' then 'Text-only' else '' end klass,
    case when v and fusion in ('', 'Not reported') then 'cross-attention' when not v and vision = '' and fusion in ('', 'Not reported') then 'Not applicable' else fusion end fusion,
    case when v and objectives in ('', 'n/a') then 'contrastive, ITM' when not v and vision = '' and objectives in ('', 'n/a') then 'Not applicable' else objectives end objectives,
    coalesce(nullif(train, ''), eval_) train, coalesce(nullif(eval_, ''), train) eval_ from (
    select o_orderkey, o_orderkey % 5 = 0 or (vision <> '' and lang <> '') v, vision, lang, fusion, objectives, train, eval_ from (
    select o_orderkey, case when o_orderkey % 2 = 0 then 'ViT' else '' end vision, case when o_orderkey % 3 = 0 then 'BERT' else '' end lang, case when o_orderkey % 7 = 0 then 'late' when o_orderkey % 7 = 1 then 'Not reported' else '' end fusion,
    case when o_orderkey % 4 = 0 then 'n/a' else 'MLM' end objectives, case when o_orderkey % 3 = 1 then '' else o_orderstatus end train, case when o_orderkey % 4 = 1 then '' else 'E' end eval_ from orders))""")
def row_derivation_chain(spark, sf_dir):
    """Class, fusion, objectives and data sets of a record by its other columns."""
    k = "o_orderkey"
    d = table(spark, sf_dir, "orders").selectExpr(
        k, f"if({k} % 5 = 0, 'yes', '') vlm", f"if({k} % 2 = 0, 'ViT', '') vision", f"if({k} % 3 = 0, 'BERT', '') language", f"case when {k} % 7 = 0 then 'late' when {k} % 7 = 1 then 'Not reported' else '' end fusion",
        f"if({k} % 4 = 0, 'n/a', 'MLM') objectives", f"if({k} % 3 = 1, '', o_orderstatus) train", f"if({k} % 4 = 1, '', 'E') eval_", "'' model", "'' family", "'' rag", "'' klass",
    )
    out = derive.clean_record(d, [("clip", "CLIP")], ["blip"])
    return out.select(k, "klass", "fusion", "objectives", "train", "eval_")


@query("""select b.item_id, count(d.doc_id) n from benchmark b left join documents d on trim(b."text") <> '' and contains(lower(d."text"), lower(trim(b."text"))) group by b.item_id""")
def evidence_gate(spark, sf_dir):
    """In how many documents each benchmark item occurs word for word, as a whole."""
    items = table(spark, sf_dir, "benchmark")
    found = lexicon.whole_items(table(spark, sf_dir, "documents"), items, "doc_id", "item_id").groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return items.select("item_id").distinct().join(found, "item_id", "left").fillna(0, ["n"])


@query("""with s as (select doc_id, unnest(string_split("text", chr(10))) section, unnest(range(len(string_split("text", chr(10))))) i from documents)
select doc_id, row_number() over (partition by doc_id order by (contains(section, 'the'))::int + (contains(section, 'que'))::int desc, length(section) desc, i)::int rank, section from s where length(section) > 200""")
def section_rank(spark, sf_dir):
    """Long sections, those with preferred words first."""
    return windows.ranked_sections(table(spark, sf_dir, "documents"), "doc_id", "text", "\n", ["(?-i)the", "(?-i)que"])


@query("""with s as (select doc_id, trim(unnest(string_split("text", chr(10))[1:40])) line, unnest(range(least(40, len(string_split("text", chr(10)))))) i from documents),
f as (select *, length(line) n, length(line) - length(replace(line, ',', '')) c from s),
g as (select *, round(0.55::double * least(n, 160) / 160 + 0.25::double / (1 + c) + 0.20::double / (1 + i), 9) score from f where n between 8 and 180 and c <= 3 and len(regexp_split_to_array(line, ' +')) >= 4)
select doc_id, line title from g qualify row_number() over (partition by doc_id order by score desc, i desc) = 1""")
def title_line(spark, sf_dir):
    """The line that looks most like a title."""
    return windows.title_line(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""select doc_id, (st / 800)::int chunk_id, st::int start, substr("text", st + 1, 1600) chunk from (select doc_id, "text", unnest(range(0, length("text"), 800)) st from documents)""".replace("(st / 800)", "(st // 800)"))
def chunks(spark, sf_dir):
    """Windows of 1600 characters at every 800."""
    return windows.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""with c as (select doc_id, st // 800 chunk_id, substr("text", st + 1, 1600) chunk from (select doc_id, "text", unnest(range(0, length("text"), 800)) st from documents)),
u as (select *, sum(length(chunk)) over (partition by doc_id order by chunk_id rows unbounded preceding) upto from c), v as (select *, upto - length(chunk) before from u)
select doc_id, count(*) n, sum(least(length(chunk), 6000 - before))::bigint chars from v where before < 6000 group by doc_id""")
def context_budget(spark, sf_dir):
    """Chunks within a budget of characters, the last one cut."""
    parts = windows.budget(windows.chunks(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "chunk_id", "chunk", 6000, cut_last=True)
    return parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("chunk")).alias("chars"))


@query("""with c as (select doc_id, st // 800 chunk_id, substr("text", st + 1, 1600) chunk from (select doc_id, "text", unnest(range(0, length("text"), 800)) st from documents))
select doc_id, count(distinct left(chunk, 200)) n from c group by doc_id""")
def chunk_dedupe(spark, sf_dir):
    """Chunks whose beginnings differ."""
    parts = windows.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    kept = windows.distinct_parts(parts, "doc_id", "chunk_id", F.left("chunk", F.lit(200)))
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


# --- retrieval ---------------------------------------------------------------------------------------


TOPK = """with q as (select vec_id, embedding::double[] e from embeddings where vec_id % 100 = 0), s as (
    select q.vec_id "query", r.vec_id key, round(list_dot_product(q.e, r.embedding::double[]), 9) score from q join embeddings r on r.vec_id <> q.vec_id)
select "query", key, round(score, 6) score, row_number() over (partition by "query" order by score desc, key)::int rank from s qualify row_number() over (partition by "query" order by score desc, key) <= 10"""


@query(TOPK)
def topk_similarity(spark, sf_dir):
    """The ten nearest vectors of every hundredth."""
    v = table(spark, sf_dir, "embeddings")
    return retrieve.top_k(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding", 10).withColumn("score", F.round("score", 6))


@query(TOPK)
def topk_indexed(spark, sf_dir):
    """The same from a store in cells, written in two goes and searched the exact way."""
    v, at = table(spark, sf_dir, "embeddings"), scratch(spark)
    vectors.write_store(v.where("vec_id % 2 = 0"), "vec_id", "embedding", at)
    vectors.append(v.where("vec_id % 2 = 1"), "vec_id", "embedding", at)
    return vectors.search(v.where("vec_id % 100 = 0"), "vec_id", "embedding", at, scratch(spark)).withColumn("score", F.round("score", 6))


@query("""with recursive v as (select vec_id id, embedding::double[] e from embeddings), s as (select q.id "query", r.id key, round(list_dot_product(q.e, r.e), 9) score from v q join v r on r.id <> q.id where q.id % 100 = 0),
n as (select *, row_number() over (partition by "query" order by score desc, key) rank from s qualify row_number() over (partition by "query" order by score desc, key) <= 24),
d as (select a."query", a.key a, b.key b, list_dot_product(x.e, y.e) dot from n a join n b on a."query" = b."query" join v x on x.id = a.key join v y on y.id = b.key),
r as (select "query", 0 step, []::bigint[] picked, null::bigint key from (select distinct "query" from n) union all
    select "query", step + 1, list_append(picked, best), best from (select r."query", r.step, r.picked, (select c.key from (select n.key, n.rank, round(0.5::double * n.score - 0.5::double * coalesce((select max(d.dot) from d where d."query" = n."query" and d.a = n.key and list_contains(r.picked, d.b)), 0), 9) x
        from n where n."query" = r."query" and not list_contains(r.picked, n.key)) c order by c.x desc, c.rank limit 1) best from r where r.step < 5))
select "query", key, step::int rank from r where step > 0""")
def mmr(spark, sf_dir):
    """Five of the 24 nearest vectors of every hundredth by marginal relevance."""
    v = table(spark, sf_dir, "embeddings")
    return retrieve.mmr(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding")


@query("""with w as (select doc_id, list_filter(regexp_split_to_array(lower("text"), '[^a-z0-9]+'), lambda x: x <> '') w from documents),
t as (select doc_id, len(w) n, len(list_filter(w, lambda x: x = 'license'))::double t0, len(list_filter(w, lambda x: x = 'apache'))::double t1 from w),
a as (select count(*) docs, avg(n) mean, count_if(t0 > 0) d0, count_if(t1 > 0) d1 from t)
select doc_id, round(ln(1 + (docs - d0 + 0.5::double) / (d0 + 0.5::double)) * t0 * 2.5::double / (t0 + 1.5::double * (0.25::double + 0.75::double * n / mean))
    + ln(1 + (docs - d1 + 0.5::double) / (d1 + 0.5::double)) * t1 * 2.5::double / (t1 + 1.5::double * (0.25::double + 0.75::double * n / mean)), 6) score from t, a where t0 + t1 > 0""")
def bm25(spark, sf_dir):
    """Documents by their match with two words."""
    return retrieve.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", ["license", "apache"], scratch(spark))


@query("""with w as (select doc_id, unnest(regexp_extract_all(lower("text"), '[a-z0-9]+')) term from documents), d as (select doc_id, len(regexp_extract_all(lower(coalesce("text", '')), '[a-z0-9]+')) n from documents),
a as (select count(*)::double docs, avg(n) mean from d), t as (select doc_id, term, count(*)::double tf from w group by all), f as (select term, count(*)::double df from t group by term),
q as (select distinct item_id "query", unnest(regexp_extract_all(lower("text"), '[a-z0-9]+')) term from benchmark), l as (select * from q where length(term) > 5),
s as (select "query", doc_id doc, round(sum(ln(1 + (docs - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * n / mean))), 6) score
    from l join f using (term) join t using (term) join d using (doc_id), a group by all)
select "query", row_number() over (partition by "query" order by score desc, doc)::int as "rank", doc, score from s qualify row_number() over (partition by "query" order by score desc, doc) <= 10""")
def bm25_index(spark, sf_dir):
    """The ten documents that match the longer words of each benchmark item best, from a stored index of words."""
    at = scratch(spark)
    search.write_index(table(spark, sf_dir, "documents"), "doc_id", "text", at)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.explode(search.words(F.col("text"))).alias("term"))
    return search.search(spark, at, items.where("char_length(term) > 5"), scratch(spark), 10)


# --- keys and profiles ---------------------------------------------------------------------------------


@query("""with a as (select distinct doc_id from documents), b as (select distinct doc_id from labels), c as (select distinct item_id doc_id from benchmark)
select 'documents' part, count(*) n from a union all select 'labels', count(*) from b union all select 'items', count(*) from c
union all select 'documents&items', count(*) from a join c using (doc_id) union all select 'documents&labels', count(*) from a join b using (doc_id)
union all select 'items&labels', count(*) from c join b using (doc_id) union all select 'documents&items&labels', count(*) from a join b using (doc_id) join c using (doc_id)""")
def key_alignment(spark, sf_dir):
    """Keys that tables have in common."""
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id")
    return profile.alignment({"documents": table(spark, sf_dir, "documents"), "labels": table(spark, sf_dir, "labels"), "items": items}, "doc_id")


@query("select doc_id from documents except select doc_id from labels")
def anti_missing(spark, sf_dir):
    """Documents without labels."""
    return profile.only_in(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("""select event_type "value", count(*) n, round(100.0::double * count(*) / sum(count(*)) over (), 2) percent from events group by event_type""")
def value_counts(spark, sf_dir):
    """Counts and shares of event types."""
    return profile.value_counts(table(spark, sf_dir, "events"), "event_type")


@query("select o_orderpriority \"value\", count_if(o_orderstatus = 'O')::bigint O, count_if(o_orderstatus = 'F')::bigint F, count_if(o_orderstatus = 'P')::bigint P from orders group by 1")
def crosstab(spark, sf_dir):
    """Orders by priority and status."""
    return profile.cross_table(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["O", "F", "P"])


@query(f"""with g as ({GOLD}), p as ({PRED})
select 'priority' field, (select count(distinct priority) from g) before, (select count(distinct priority) from p) after, (select count(distinct priority) from p) - (select count(distinct priority) from g) delta
union all select 'status', (select count(distinct status) from g), (select count(distinct status) from p where trim(status) <> 'n/a'), (select count(distinct status) from p where trim(status) <> 'n/a') - (select count(distinct status) from g)""")
def diversity(spark, sf_dir):
    """Distinct values of two versions."""
    return profile.diversity(*versions(spark, sf_dir), ["priority", "status"])


@query("""select k field, json_extract_string(props, '$.' || k) source, count(*) n from (select props, unnest(json_keys(props)) k from events) group by 1, 2""")
def provenance_counts(spark, sf_dir):
    """Sources by field in a column of JSON maps."""
    return profile.provenance(table(spark, sf_dir, "events"), "props")


@query("""select source, unnest(list_sort(list(doc_id))) doc_id from documents group by source""")
def manifest_explode(spark, sf_dir):
    """A manifest with a list cell for each source, taken apart again."""
    m = table(spark, sf_dir, "documents").groupBy("source").agg(F.expr("listagg(cast(doc_id as string), ';') within group (order by doc_id)").alias("snippets"))
    return m.select("source", F.explode(F.split("snippets", ";")).alias("doc_id")).select("source", F.col("doc_id").cast("long").alias("doc_id"))


@query(r"""select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&[a-z]+;', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) "text" from pages""")
def html_text_clean(spark, sf_dir):
    """Pages without tags and entities, white space squeezed."""
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "&[a-z]+;", " "), "[ \t\n\r]+", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.trim(c).alias("text"))


@query("""select n_name, regexp_replace(n_name || '.txt', '\\.txt$', '') one_txt, lower(n_name) "lower", n_name cased from nation""")
def key_variants(spark, sf_dir):
    """Keys in several spellings."""
    n = table(spark, sf_dir, "nation")
    k = F.concat("n_name", F.lit(".txt"))
    return n.select("n_name", *[missing.norm_key(k, v).alias(v) for v in ("one_txt", "lower", "cased")])


@query("""select o_orderkey, case when o_orderstatus = 'F' then 'No' when o_orderstatus = 'O' then 'Not reported' else 'Yes' end state from orders""")
def tri_state(spark, sf_dir):
    """Yes, No or Not reported."""
    said = F.expr("case o_orderstatus when 'F' then ' false' when 'P' then 'Y' else o_orderstatus end")
    return table(spark, sf_dir, "orders").select("o_orderkey", missing.tri_state(said).alias("state"))


@query("""select conv_id key, "text" answer from conversations where role = 'assistant' qualify row_number() over (partition by conv_id order by turn) = 1""")
def first_answer(spark, sf_dir):
    """The first answer of each conversation."""
    c = table(spark, sf_dir, "conversations")
    return fuse.first_answer(c.withColumn("text", F.when(F.col("role") == "assistant", F.col("text"))), "conv_id", "text", "turn")


from . import records as _records, tables as _tables  # noqa: E402, F401  they register their queries, with the decorator from above
