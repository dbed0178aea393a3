"""Queries over sources, sinks and alignments, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon, tokens
from ..functions import vocabulary as v
from ..operators import evaluate, extract, fuse, numbering, report, rounds, windows
from ..sources import ledger, readers, writers
from ..streaming import windowed_counts
from .queries import query, table
from .scratch import scratch


@query("""select p_partkey::varchar "File", replace(p_name, ' ', ', "') "Model", p_brand "Brand", '' "RAG", '' "Metrics(primary)" from part""")
def csv_roundtrip(spark, sf_dir):
    """A table written as CSV with a fixed header and read back as strings."""
    at = scratch(spark)
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("File"), F.replace("p_name", F.lit(" "), F.lit(', "')).alias("Model"), F.col("p_brand").alias("Brand"))
    writers.write_csv(p, at, ["File", "Model", "Brand"], one_file=False)
    return readers.read_csv(spark, at, fill=True)


@query("select n_nationkey, n_name, r_name, null::varchar gone from nation join region on r_regionkey = n_regionkey")
def json_roundtrip(spark, sf_dir):
    """Rows written as JSON, nulls too, and read back."""
    at = scratch(spark)
    r = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    d = table(spark, sf_dir, "nation").join(r, "n_regionkey").select("n_nationkey", "n_name", "r_name", F.lit(None).cast("string").alias("gone"))
    writers.write_json(d, at, "r_name")
    return spark.read.schema("n_nationkey int, n_name string, gone string, r_name string").json(at)


@query("select item_id, length(\"text\") n from benchmark where length(\"text\") >= 100")
def new_texts(spark, sf_dir):
    """Texts of some length, appended once however often they come."""
    at, b = scratch(spark), table(spark, sf_dir, "benchmark")
    for _ in range(2):
        writers.write_new_texts(b, at, "item_id", "text", 100)
    return ledger.read(spark, at).select("item_id", F.char_length("text").alias("n"))


@query("select vec_id doc_id, list_sum(embedding::double[]) total from embeddings where vec_id = 7")
def vector_store(spark, sf_dir):
    """A stored vector read back by its document: one part of the store is read."""
    at = scratch(spark)
    writers.write_vectors(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), at)
    one = readers.read_vectors(spark, at, 7)
    return one.select("doc_id", F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("""select c_custkey, '| ' || replace(c_name, '#', '\\|') || ' | ' || coalesce(c_mktsegment, '') || ' |' line, case when length(c_mktsegment) > 6 then left(replace(c_mktsegment, 'I', '/'), 5) || '…' else replace(c_mktsegment, 'I', '/') end cell from customer""")
def markdown_cells(spark, sf_dir):
    """Rows and cells for a Markdown table."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.replace("c_name", F.lit("#"), F.lit("|")).alias("name"), "c_mktsegment")
    line = F.concat(F.lit("| "), writers.escape_cell(F.col("name")), F.lit(" | "), writers.escape_cell(F.col("c_mktsegment")), F.lit(" |"))
    return c.select("c_custkey", line.alias("line"), writers.clean_cell(F.replace("c_mktsegment", F.lit("I"), F.lit("|")), 6).alias("cell"))


@query(r"""select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace("text", '[\x00-\x08\x0B-\x1F]', '', 'g'), '(\w)-\n(\w)', '\1\2', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g') "text" from documents""")
def clean_texts(spark, sf_dir):
    """Texts without control characters, broken words joined, blanks squeezed."""
    return table(spark, sf_dir, "documents").select("doc_id", readers.clean_text(F.col("text")).alias("text"))


@query("""with d as (select doc_id, coalesce("text", '') t from documents), a as (select doc_id, regexp_extract(left(t, 200), '([0-9]{3,})', 1) a, regexp_extract(left(t, 2000), '([0-9]{3,})', 1) b, regexp_extract(t, '([0-9]{3,})', 1) c from d)
select doc_id, case when a <> '' then a when b <> '' then b when c <> '' then c else 'Not reported' end answer, case when a <> '' then 1 when b <> '' then 2 when c <> '' then 3 end::int "round" from a""")
def answers_in_rounds(spark, sf_dir):
    """A long number of each document, asked of its beginning, of more of it, and of all of it, by a rule in a model's place."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    prompts = [F.left("text", F.lit(200)), F.left("text", F.lit(2000)), F.col("text")]
    rule = lambda asked: asked.withColumn("answer", F.regexp_extract("prompt", "([0-9]{3,})", 1))
    return rounds.in_rounds(d, prompts, rule, lambda a: a != "", scratch(spark), F.lit("Not reported")).drop("text")


@query("""with k as (select distinct upper(split_part(p_name, ' ', 1)) key from part)
select key, (select string_agg(p_type, chr(10) order by p_name, p_type) from part where contains(lower(p_name), lower(key))) "text" from k""")
def documents_by_name(spark, sf_dir):
    """For each word all parts whose name holds it, their types joined in order of the names."""
    p = table(spark, sf_dir, "part")
    words = p.select(F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("key")).distinct()
    return readers.match_documents(words, p, "key", "p_name", "p_type")


@query("""select p_partkey, p_name model, 'true' vlm, '{"model": "' || p_name || '", "note": "a } brace", "vlm": True}' block from part""")
def answers_parsed(spark, sf_dir):
    """Fields of an answer that holds JSON among other text, and its balanced block."""
    said = F.concat(F.lit('so: {"model": "'), "p_name", F.lit('", "note": "a } brace", "vlm": True} and {more}'))
    d = table(spark, sf_dir, "part").select("p_partkey", said.alias("said")).withColumn("block", readers.balanced_block(F.col("said")))
    return d.withColumn("r", readers.parse_answer(F.col("block"), ["model", "vlm"])).select("p_partkey", "r.model", "r.vlm", "block")


@query("""select p_partkey, case when p_partkey % 3 = 0 then p_brand || ',' || p_name when p_partkey % 3 = 1 then p_name else 'Not reported' end items, case when p_partkey % 3 = 0 then p_brand when p_partkey % 3 = 1 then p_name else 'Not reported' end head from part""")
def list_cells(spark, sf_dir):
    """Cells that may hold a JSON list, as lists and as single values."""
    cell = F.when(F.col("p_partkey") % 3 == 0, F.to_json(F.array("p_brand", "p_name"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" "), "p_name")).otherwise(" ")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(readers.to_list(cell), ",").alias("items"), readers.first_scalar(cell).alias("head"))


@query("""select doc_id, st // 800 chunk_id, case when contains(c, 'license') then 'legal' when contains(c, ' que ') then 'que' else 'body' end section from (
    select doc_id, st, lower(substr("text", st + 1, 1600)) c from (select doc_id, "text", unnest(range(0, length("text"), 800)) st from documents))""".replace("st // 800", "(st // 800)::int"))
def section_labels(spark, sf_dir):
    """The section of each chunk by the first keyword that it has."""
    c = windows.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return c.select("doc_id", "chunk_id", windows.section_of(F.col("chunk"), [("license", "legal"), (" que ", "que")]).alias("section"))


@query("""with t as (select doc_id, lower("text") t from documents)
select doc_id, coalesce(array_to_string(list_transform(list_sort(list_filter([{'at': strpos(t, 'the'), 'x': 'the'}, {'at': strpos(t, 'que'), 'x': 'que'}, {'at': strpos(t, 'license'), 'x': 'License'}], lambda x: x.at > 0)), lambda x: x.x), ','), '') terms from t""")
def terms_in_order(spark, sf_dir):
    """Plain terms by the place of their first occurrence."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.array_join(lexicon.terms_by_position(F.col("text"), ["the", "que", "License"]), ","), F.lit("")).alias("terms"))


@query("""select doc_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all("text", '(?i)(mit|apache|gpl|bsd)'), lambda x: case lower(x) when 'mit' then 'MIT' when 'bsd' then 'MIT' else lower(x) end))), ','), '') names from documents""")
def findall_canonical(spark, sf_dir):
    """All distinct matches by the labels of their spellings."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.array_join(lexicon.find_all(F.col("text"), "(?i)(?:mit|apache|gpl|bsd)", {"mit": "MIT", "bsd": "MIT"}), ","), F.lit("")).alias("names"))


@query("""with t as (select p_partkey, string_split(p_name || ' ' || upper(p_name) || ' ' || p_brand, ' ') l from part)
select p_partkey, array_to_string(list_transform([l], lambda z: list_filter(z, lambda x, i: list_position(list_transform(z, lambda y: lower(y)), lower(x)) = i))[1], ',') items from t""")
def distinct_any_case(spark, sf_dir):
    """Tokens that differ in more than their case, the first spelling of each."""
    t = F.split(F.concat_ws(" ", "p_name", F.upper("p_name"), "p_brand"), " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tokens.distinct_ci(t), ",").alias("items"))


@query("""select d.doc_id key, 'lang' field, d.lang gold, l.q pred from documents d join (select doc_id, quality::varchar q from labels) l using (doc_id)""")
def inner_pairs(spark, sf_dir):
    """Pairs of the keys that both tables have."""
    gold, pred = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumn("lang", F.col("quality").cast("string"))
    return evaluate.pairs(gold, pred, "doc_id", ["lang"], how="inner")


@query("""with o as (select * from orders qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1)
select c_custkey, o_orderkey, o_orderpriority, n_name from o join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey""")
def last_row_wins(spark, sf_dir):
    """A three-way join in which the last row of a repeated key counts."""
    o = evaluate.last_wins(table(spark, sf_dir, "orders"), F.col("o_custkey"), "o_orderkey").withColumnRenamed("o_custkey", "c_custkey")
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return o.join(table(spark, sf_dir, "customer"), "c_custkey").join(n, "c_nationkey").select("c_custkey", "o_orderkey", "o_orderpriority", "n_name")


@query("""with a as (select n_name, row_number() over (order by n_nationkey) place from nation), b as (select r_name, row_number() over (order by r_regionkey) place from region)
select place::int place, n_name, r_name from a full join b using (place)""")
def rows_by_position(spark, sf_dir):
    """Rows of two tables side by side by their place."""
    n, r = table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    out = numbering.by_position(n, r, "n_nationkey", "r_regionkey", scratch(spark))
    return out.select(F.col("place").cast("int").alias("place"), F.col("a.n_name").alias("n_name"), F.col("b.r_name").alias("r_name"))


@query("""with a as (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) place from orders), b as (select l_orderkey, l_linenumber, row_number() over (order by l_shipdate, l_orderkey, l_linenumber) place from lineitem)
select place, o_orderkey, l_orderkey, l_linenumber from a full join b using (place)""")
def tables_by_position(spark, sf_dir):
    """Orders by date beside lines by date, as far as either goes."""
    o = table(spark, sf_dir, "orders").select(F.struct("o_orderdate", "o_orderkey").alias("at"))
    n = table(spark, sf_dir, "lineitem").select(F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("at"))
    out = numbering.by_position(o, n, "at", "at", scratch(spark))
    return out.select("place", "a.at.o_orderkey", "b.at.l_orderkey", "b.at.l_linenumber")


@query("select l_orderkey, l_linenumber, row_number() over (order by l_extendedprice desc, l_quantity desc, l_orderkey, l_linenumber) place from lineitem")
def ranked_by_two_columns(spark, sf_dir):
    """Lines by price and quantity, the highest first, with their places."""
    n = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return numbering.numbered(n, scratch(spark), F.desc("l_extendedprice"), F.desc("l_quantity"), "l_orderkey", "l_linenumber").drop("l_extendedprice", "l_quantity")


@query("""with a as (select unnest(['p_brand', 'p_size']) field, unnest([count_if(p_brand is null), 0]) missing_a, unnest([count(distinct p_brand), count(distinct p_size)]) unique_a from part),
b as (select unnest(['p_brand', 'p_type']) field, unnest([count_if(p_size % 2 = 0), 0]) missing_b, unnest([count(distinct case when p_size % 2 <> 0 then p_brand end), count(distinct p_type)]) unique_b from part)
select field, missing_a::bigint missing_a, unique_a, missing_b::bigint missing_b, unique_b from a full join b using (field)""")
def columns_compared(spark, sf_dir):
    """Missing cells and distinct values of two versions whose columns differ."""
    p = table(spark, sf_dir, "part")
    a, b = p.select("p_brand", "p_size"), p.selectExpr("if(p_size % 2 = 0, null, p_brand) as p_brand", "p_type")
    return report.side_by_side("field", report.column_figures(a, "a"), report.column_figures(b, "b"))


@query("""with s as (select l_orderkey, l_linenumber, (l_returnflag <> 'N')::int + (l_linestatus <> 'O')::int + 2 score from lineitem)
select l_orderkey, l_linenumber, score from s qualify row_number() over (partition by l_orderkey order by score desc, l_linenumber) = 1""")
def fullest_row(spark, sf_dir):
    """The row of each key that says most, lists by their elements."""
    d = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "array('x', 'Not reported', 'y') as items", "if(l_returnflag = 'N', 'Not reported', l_returnflag) as flag", "if(l_linestatus = 'O', '', l_linestatus) as status"
    )
    d = d.withColumn("score", fuse.answer_count(["items"], ["flag", "status"]))
    return fuse.best_row(d, F.col("l_orderkey"), [F.col("score")], "l_linenumber").select("l_orderkey", "l_linenumber", "score")


@query("""select count(*) expected, count_if(lang = 'en' or (lang = 'fr' and doc_id % 2 = 0))::bigint "right", round(count_if(lang = 'en' or (lang = 'fr' and doc_id % 2 = 0))::double / count(*), 6) accuracy from documents""")
def answer_accuracy(spark, sf_dir):
    """The share of expected answers that are given exactly; those never given count."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    given = d.where("lang <> 'de'").withColumn("lang", F.expr("case when lang = 'en' then 'en' when lang = 'fr' and doc_id % 2 = 0 then 'fr' else 'xx' end"))
    return evaluate.accuracy(d, given, "doc_id", "lang")


@query("""select time_bucket(interval 1 day, ts) as day, event_type kind, count(*) n from events group by all""")
def window_counts(spark, sf_dir):
    """Events by day and kind; the same transformation serves a stream."""
    w = windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "1 day", "1 hour")
    return w.select(F.col("window.start").alias("day"), F.col("event_type").alias("kind"), "n")


# --- records from texts by cues and anchors ----------------------------------------------------------------------------

SAID = (
    "", "We train on MIMIC-CXR with reports; much further away stands the evaluation on IU X-ray test data.", "The image encoder is a ViT backbone and the language model a LLaMA decoder; cross-attention fusion.",
    "BLIP-2 and ALBEF, vision-language, for radiology report generation; BLEU and CIDEr.", "A CNN image encoder with a Transformer decoder of text; ITM is the loss.", "CT-scan, computed tomography and CheXpert.",
    "Retrieval-augmented with FAISS and CLIP vision.", "BLIP and a transformer with text; an MRI.", "Paired data and caption of Open-i, nothing else.",
)
CASED = "concat(coalesce(\"text\", ''), ' ', split_part('" + "|".join(SAID) + f"', '|', cast(doc_id % {len(SAID)} as int) + 1))"
#: Patterns that look ahead, which some engines lack: what hides the cases they exclude, at the same length.
HIDDEN = {r"\bblip\b(?!-?2)": (r"blip(-?2)", r"xlip\1", r"\bblip\b"), r"\btransformer\b(?! with)": (r"transformer( with)", r"xransformer\1", r"\btransformer\b")}


def s_text(pattern: str) -> tuple[str, str]:
    """The text to look in and the pattern without a look-ahead."""
    if pattern not in HIDDEN:
        return "t", pattern
    what, instead, plain = HIDDEN[pattern]
    return f"regexp_replace(t, '(?i){what}', '{instead}', 'g')", plain


def s_any(patterns, text: str | None = None) -> str:
    parts = [(text or s_text(p)[0], s_text(p)[1]) for p in patterns]
    return "(" + " or ".join(f"regexp_matches({t}, '(?i){p}')" for t, p in parts) + ")"


def s_windows(pattern: str, width: int = 80) -> str:
    """The surroundings of the beginning of every match."""
    t, p = s_text(pattern)
    at = "coalesce(list_sum(list_transform(x.s[1:i], lambda y: length(y))), 0)::bigint + coalesce(list_sum(list_transform(x.m[1:i - 1], lambda y: length(y))), 0)::bigint"
    near = f"list_transform(list_transform(range(1, len(x.m) + 1), lambda i: {at}), lambda q: substr(t, greatest(0, q - {width}) + 1, q + {width} - greatest(0, q - {width})))"
    return f"list_transform([{{'s': regexp_split_to_array({t}, '(?i){p}'), 'm': regexp_extract_all({t}, '(?i){p}')}}], lambda x: {near})[1]"


def s_around(patterns) -> str:
    out = "[]::varchar[]"
    for p in patterns:
        out = f"list_concat({out}, case when {s_any([p])} then {s_windows(p)} else []::varchar[] end)"
    return out


def s_when(pairs) -> str:
    """The labels whose condition holds, in order."""
    return "list_filter([" + ", ".join(f"case when {c} then '{label}' end" for c, label in pairs) + "], lambda x: x is not null)"


def s_near(patterns, condition: str) -> str:
    return f"len(list_filter({s_around(patterns)}, lambda w: {condition})) > 0"


def s_cues(cues) -> str:
    return s_when([(s_any(ps), label) for label, ps in cues.items()])


def s_anchored(field: str, cues) -> str:
    return s_when([(s_near(ps, s_any(v.ANCHORS[field], "w")), label) for label, ps in cues.items()])


def s_role(role, other) -> str:
    return "list_sort(" + s_when([(s_near(ps, f"{s_any(role, 'w')} or not {s_any(other, 'w')}"), d) for d, ps in v.DATASETS.items()]) + ")"


S_PAIRED = " or ".join(s_near(ps, s_any(v.REPORT_WORDS, "w") + ("" if d in v.PAIRED_DATASETS else f" and {s_any(v.PAIRED_PHRASES, 'w')}")) for d, ps in v.DATASETS.items())
S_LOCKED = s_when([("true", "X-Ray"), *[(f"{s_any([a])} and {s_any([b])}", m) for m, (a, b) in v.OTHER_MODALITIES.items()]])
S_SORTED = "array_to_string(list_transform(list_sort(list_transform({0}, lambda x: lower(x) || chr(1) || x)), lambda x: split_part(x, chr(1), 2)), ', ')"
S_VLMS = ", ".join(f"'{x}'" for x in v.VLM_FAMILIES)
EXTRACT = f"""with d as (select doc_id, {CASED} t from documents),
f as (select doc_id, t, {s_role(v.TRAIN_WORDS, v.EVAL_WORDS)} train, {s_role(v.EVAL_WORDS, v.TRAIN_WORDS)} eval_, {S_PAIRED} paired, {s_anchored('vision', v.VISION)} vision, {s_anchored('language', v.LANGUAGE)} lang,
    {s_anchored('fusion', v.FUSION)} fusion, {s_anchored('objectives', v.OBJECTIVES)} objectives, {s_cues(v.FAMILIES)} family, {s_cues(v.METRICS)} metrics, {s_cues(v.TASKS)} task, {s_any(v.RAG)} rag,
    {s_any(v.VLM_PHRASES)} claims, {s_cues(v.MODALITIES)} cues, {S_LOCKED} locked from d),
g as (select *, list_has_any(family, [{S_VLMS}]) or (claims and len(vision) > 0 and len(lang) > 0) vlm from f)
select doc_id::varchar "File", array_to_string(case when len(train) + len(eval_) > 0 then locked else cues end, ', ') "Modality", array_to_string(train, ', ') "Datasets (train)", array_to_string(eval_, ', ') "Datasets (eval)",
    case when paired then 'Yes' else '' end "Paired", case when vlm then 'Yes' else '' end "VLM?", {S_SORTED.format('family')} "Model", {S_SORTED.format('family')} "Family",
    case when vlm then 'VLM (multimodal)' when list_contains(vision, 'CNN') and list_has_any(lang, ['Transformer', 'BERT']) then 'CNN+Transformer' when list_has_any(vision, ['ViT', 'CLIP']) and list_contains(lang, 'Transformer') then 'Encoder–Decoder' else '' end "Class",
    array_to_string(task, ', ') "Task", {S_SORTED.format('vision')} "Vision Enc", {S_SORTED.format('lang')} "Lang Dec", {S_SORTED.format('fusion')} "Fusion", {S_SORTED.format('objectives')} "Objectives",
    case when rag then 'Yes' else '' end "RAG", {S_SORTED.format('metrics')} "Metrics(primary)" from g"""


@query(EXTRACT)
def extract_records(spark, sf_dir):
    """A sixteen-column record of every document, to which a sentence with cues is added by a rule."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(CASED.replace('"text"', "text")).alias("text"))
    return extract.extract(d)
