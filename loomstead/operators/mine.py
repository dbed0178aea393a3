"""What texts tell of themselves: keyword windows, titles, authors, model names, objectives, evidence.

Everything is expressions over one text, so a corpus is read once and nothing moves.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.lexicon import Lexicon, all_labels, any_match, matches
from ..functions.literals import Lexicons, has, in_order, trie
from ..functions.missing import NOT_REPORTED, is_missing, strip
from ..functions.names import fresh
from ..functions.tokens import distinct_ci


def spans(text: Column, pattern: str, width: int) -> Column:
    """Array of (st, en), in characters from 0: every match and ``width`` characters on either side."""
    pieces, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    sizes = F.zip_with(F.slice(F.transform(pieces, F.char_length), F.lit(1), F.size(found)), F.transform(found, F.char_length), lambda a, b: F.struct(a.alias("gap"), b.alias("own")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<st:int,en:int>>").alias("out"))
    step = lambda s, x: F.struct(
        (s["at"] + x["gap"] + x["own"]).alias("at"),
        F.array_append(s["out"], F.struct(F.greatest(F.lit(0), s["at"] + x["gap"] - width).alias("st"), F.least(F.char_length(text), s["at"] + x["gap"] + x["own"] + width).alias("en"))).alias("out"),
    )
    return F.aggregate(sizes, start, step, lambda s: s["out"])


def windows(text: Column, pattern: str, width: int) -> Column:
    """The surroundings of every match."""
    return F.transform(spans(text, pattern, width), lambda x: F.substring(text, x["st"] + 1, x["en"] - x["st"]))


def first_windows(text: Column, patterns: Sequence[str], width: int = 240, most: int = 6) -> Column:
    """The surroundings of the first matches, pattern after pattern."""
    return F.slice(F.concat(*[windows(text, f"(?im){p}", width) for p in patterns]), 1, most)


def joined_windows(text: Column, terms: Sequence[str], width: int = 400, most: int = 6000) -> Column:
    """The surroundings of all plain terms, one after the other, within ``most`` characters."""
    each = F.concat(*[windows(text, f"(?i)\\Q{t}\\E", width) for t in terms])
    return F.left(F.array_join(each, "\n...\n"), F.lit(most))


def clamp(answer: Column, context: Column, allowed: Sequence[str]) -> Column:
    """The answer if its context has it, else the first allowed value that the context has."""
    low = F.lower(F.coalesce(context, F.lit("")))
    there = [F.when(F.contains(low, F.lit(a.lower())), F.lit(a)) for a in allowed]
    own = F.trim(answer)
    return F.coalesce(F.when((own != "") & F.contains(low, F.lower(own)), own), *there, F.lit(NOT_REPORTED))


def evidence(token: Column, context: Column, patterns: Mapping[str, str] = v.EVIDENCE) -> Column:
    """Whether a token's own pattern, or the token itself, occurs in the context."""
    out = F.contains(F.lower(context), F.lower(token))
    for value, p in patterns.items():
        out = F.when(token == value, matches(context, p)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def strict_gate(cell: Column, context: Column, patterns: Mapping[str, str] = v.EVIDENCE) -> Column:
    """The tokens of a comma list that the context has evidence for; none is not reported."""
    tokens = F.filter(F.transform(F.split(cell, ","), lambda t: F.trim(t)), lambda t: (t != "") & (t != NOT_REPORTED))
    out = F.array_join(F.filter(tokens, lambda t: evidence(t, context, patterns)), ", ")
    return F.when(F.coalesce(out, F.lit("")) == "", NOT_REPORTED).otherwise(out)


# --- titles and authors ----------------------------------------------------------------------------------


def _bad_line(s: Column, stop: Sequence[str]) -> Column:
    """Addresses, links, affiliations, venues, and lines mostly in capitals."""
    letters = F.char_length(F.regexp_replace(s, r"\P{L}", ""))
    lower = F.char_length(F.regexp_replace(s, r"\P{Ll}", ""))
    out = F.lower(s).rlike(f"@|https?://|www[.]|{trie(stop)}")
    commas = F.char_length(s) - F.char_length(F.replace(s, F.lit(","), F.lit("")))
    return out | (commas > 3) | ~s.rlike("[A-Za-z]") | (lower < 0.25 * letters)


def _end(s: Column) -> Column:
    return F.regexp_replace(s, r"[ .:\-]+$", "")


def title(text: Column, stop: Sequence[str] = v.NOT_TITLE, head: int = 4500, first: int = 50) -> Column:
    """(title, at): the line before the abstract that looks most like a title, with up to two that continue it, and its place; at is -1 and the title null without one.

    ``head`` and ``first`` are the part of a paper where titles stand. The score
    prefers length, few commas and early lines; the later line wins ties.
    """
    top = F.element_at(F.split(F.left(text, F.lit(head)), r"(?i)\babstract\b", 2), 1)
    lines = F.transform(F.split(top, r"\r\n|\n|\r"), strip)
    n = lambda s: F.char_length(s)
    commas = lambda s: n(s) - n(F.replace(s, F.lit(","), F.lit("")))
    fits = lambda s: n(s).between(8, 180) & ~_bad_line(s, stop) & (F.size(F.regexp_extract_all(s, F.lit(r"([A-Za-z][A-Za-z\-]+)"), 1)) >= 4)
    score = lambda s, i: F.round(0.55 * F.least(n(s), F.lit(160)) / 160 + 0.25 / (1 + commas(s)) + 0.20 / (1 + i), 9)
    found = F.filter(F.transform(F.slice(lines, 1, first), lambda s, i: F.struct(F.when(fits(s), score(s, i)).alias("score"), i.alias("i"), s.alias("s"))), lambda x: x["score"].isNotNull())
    # the text is taken apart once; what follows reads the parts
    parts = F.struct(lines.alias("lines"), F.array_max(found).alias("best"))

    def put(x: Column) -> Column:
        best, at = x["best"], x["best"]["i"]
        one, two = (F.coalesce(F.get(x["lines"], at + k), F.lit("")) for k in (1, 2))
        goes_on = lambda s: (s != "") & (n(s) <= 160) & ~_bad_line(s, stop) & ~s.rlike(r"(?i)\babstract\b|\bkeywords\b|\bindex terms\b") & (s.rlike(r"^\p{Ll}") | ~s.rlike(r"[.:!?]\s*$"))
        more = F.when(goes_on(one), F.concat(F.lit(" "), _end(one), F.when(goes_on(two), F.concat(F.lit(" "), _end(two))).otherwise(""))).otherwise("")
        return F.struct(F.concat(_end(best["s"]), more).alias("title"), F.coalesce(at, F.lit(-1)).alias("at"))

    return F.element_at(F.transform(F.array(parts), put), 1)


def authors(text: Column, at: Column, stop: Sequence[str] = v.NOT_TITLE, head: int = 6000, most: int = 15) -> Column:
    """Names in the lines under the title (up to twelve, until a blank line or the abstract), or of a line that begins with "by"."""
    lines = F.transform(F.split(F.left(text, F.lit(head)), r"\r\n|\n|\r"), strip)
    block = F.slice(lines, F.greatest(F.lit(1), at + 2), F.lit(12))
    empty = F.struct(F.lit(False).alias("done"), F.lit("").alias("out"))
    step = lambda s, x: F.struct(
        (s["done"] | ((x == "") & (s["out"] != "")) | x.rlike(r"(?i)\babstract\b|\bkeywords\b|\bindex terms\b")).alias("done"),
        F.when(s["done"] | (x == "") | x.rlike(r"(?i)\babstract\b|\bkeywords\b|\bindex terms\b") | _bad_line(x, stop), s["out"]).otherwise(F.concat_ws(" ", F.nullif(s["out"], F.lit("")), x)).alias("out"),
    )
    under = F.aggregate(block, empty, step, lambda s: s["out"])
    by = F.get(F.filter(F.transform(F.slice(lines, 1, 40), lambda x: F.regexp_extract(x, r"(?i)^\s*by\s+(.+)$", 1)), lambda x: x != ""), F.lit(0))
    joined = F.coalesce(F.nullif(under, F.lit("")), by, F.lit(""))
    for pattern in (r"\S+@\S+\.\S+", r"(?i)\b(Member|Senior Member|Student Member|Fellow|IEEE|ACM)\b", r"[*\d\^\[\]()º°†‡§•]+", r"(?i)\bcorresponding authors?\b.*?$", r"(?i)\b(received|accepted|published)\b.*?$"):
        joined = F.regexp_replace(joined, pattern, " ")
    chunks = F.split(F.regexp_replace(joined, r"\s+", " "), r"\s+(?:and|&)\s+|[,;]")
    names = F.flatten(F.transform(chunks, lambda c: F.regexp_extract_all(F.trim(c), F.lit(f"({v.NAME})"), 1)))
    names = F.filter(names, lambda x: F.size(F.split(x, " ")).between(2, 4) & ~F.element_at(F.split(x, " "), 1).isin(*v.NOT_NAME_START))
    out = F.array_join(F.slice(F.array_distinct(names), 1, most), ", ")
    return F.when(F.coalesce(out, F.lit("")) == "", NOT_REPORTED).otherwise(out)


# --- names and objectives -----------------------------------------------------------------------------------


def models_near(text: Column, models: Sequence[str] = v.NEAR_MODELS, trigger: str = v.PROPOSES, width: int = 120, banned: Sequence[str] = v.NOT_MODEL, most: int = 4) -> Column:
    """Known names in the surroundings of "propose", "present" and the like, or at the text's beginning."""
    near = windows(text, f"(?i){trigger}", width)
    near = F.when(F.size(near) > 0, near).otherwise(F.array(F.left(text, F.lit(6000))))
    hits = F.flatten(F.transform(near, lambda w: F.array_compact(F.array(*[F.when(w.rlike(rf"\b\Q{m}\E(?!\w)"), F.lit(m)) for m in models]))))
    out = F.array_join(F.slice(F.filter(F.array_distinct(hits), lambda x: ~F.upper(x).isin(*banned)), 1, most), ", ")
    return F.when(F.coalesce(out, F.lit("")) == "", NOT_REPORTED).otherwise(out)


def objectives_in(text: Column, lexicon: Lexicon = v.BACKFILL_OBJECTIVES, sentence: str = v.LOSS_SENTENCE, metrics: Sequence[str] = v.METRIC_WORDS) -> Column:
    """Objectives by their patterns, and those near words of training unless metrics stand there too."""
    said = F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"(?i)({sentence})"), 1), F.lower), lambda s: ~any_match(s, [f"\\Q{m}\\E" for m in metrics]))
    extra = F.flatten(F.transform(said, lambda s: all_labels(s, (("contrastive", "contrastive"), ("cross[- ]entropy", "cross-entropy"), ("adversarial", "adversarial")))))
    out = F.array_join(distinct_ci(F.concat(all_labels(text, lexicon), extra)), ", ")
    return F.when(F.coalesce(out, F.lit("")) == "", NOT_REPORTED).otherwise(out)


def bank_hits(text: Column, bank: Lexicon) -> Column:
    """All labels of a bank, joined; nothing is an empty cell."""
    return F.array_join(all_labels(text, bank), ", ")


def backfill(df: DataFrame, texts: DataFrame, key: str, text: str, miners: Mapping[str, object], policy: str = "backfill") -> DataFrame:
    """Missing cells from the documents' own texts; cells that are filled, and rows without a text, stay as they are."""
    (mined,) = fresh(df, "text")
    own = texts.select(F.col(key), F.col(text).alias(mined))
    d = df.join(own, key, "left")
    for c, mine in miners.items():
        d = d.withColumn(c, F.when(is_missing(F.col(c), policy) & F.col(mined).isNotNull(), mine(F.col(mined))).otherwise(F.col(c)))
    return d.select(*df.columns)


# --- one record from one text ---------------------------------------------------------------------------------

#: Fixed values of the guessers.
GUESS_DATASETS = ("MIMIC-CXR", "CheXpert", "IU X-ray", "Open-i", "NIH ChestX-ray14", "CXR-RePaiR", "RadGraph", "PadChest", "COCO", "ImageNet")
GUESS_MODELS = ("BLIP-2", "BLIP2", "BLIP", "ALBEF", "LLaVA", "LLaMA", "GPT-4V", "GPT4V", "Flamingo", "CXR-IRGen", "TrMRG", "ViLT", "MiniGPT-4", "mPLUG", "Q-Former")
GUESS_VISION = ("ViT", "CLIP", "ResNet50", "CNN", "Swin", "ConvNeXt", "EfficientNet")
GUESS_LANGUAGE = ("LLaMA", "GPT-2", "GPT2", "GPT-4V", "BERT", "T5", "Flan-T5", "Transformer", "LSTM", "GRU")
GUESS_METRICS = ("BLEU", "CIDEr", "METEOR", "ROUGE", "Accuracy", "F1", "BERTScore", "CheXbert", "RadGraph", "RadCliQ", "GLEU")


#: Words, of which one is enough, for what a guesser says.
GUESS_FUSION = (
    ("cross-attention", ("cross-attention", "cross attention")), ("q-former", ("q-former", "qformer")), ("single-stream", ("single-stream", "single stream")),
    ("late fusion", ("late fusion",)), ("early fusion", ("early fusion",)),
)
GUESS_OBJECTIVES = (("ITM/ITC", ("itm", "image-text matching", "itc", "contrastive")), ("coverage", ("coverage",)))
GUESS_MODALITIES = ("x-ray", "xray", "x ray", "cxr", "mammography", "ct", "mri", "ultrasound")
GUESS_VLM = ("vlm", "vision-language", "vision language", "multimodal", "vqg", "report generation")
GUESS_RAG = ("retrieval-augmented", "retrieval augmented", "rag", "retrieve-then-generate")
GUESS_CONTRASTIVE, GUESS_KNOWLEDGE = ("clip", "siglip", "contrast"), ("knowledge", "retrieval", "rag")
GUESS_ENCODER_DECODER = ("blip", "blip2", "blip-2", "albef", "flan-t5", "t5")
GUESS_ADAPTERED = ("llava", "llama", "q-former", "mplug", "minigpt", "vision-instruct")
GUESS_CLASSES = ("classification", "detection", "segmentation", "retrieval", "captioning")
GUESS_TASKS = ("captioning", "retrieval", "qa", "question answering", "triage", "classification")
GUESS_REPORT = r"\breport[- ]?generation\b"


GUESSED = ("modality", "train", "eval_", "vlm", "model", "klass", "task", "vision", "language", "fusion", "objectives", "rag", "metrics", "family")


def _guess_lexicons() -> Lexicons:
    words = lambda names: [(rf"\b{k}\b", k) for k in names]
    terms = [*GUESS_DATASETS, *GUESS_MODELS, *GUESS_VISION, *GUESS_LANGUAGE, *GUESS_METRICS, *GUESS_MODALITIES, *GUESS_VLM, *GUESS_RAG, *GUESS_CONTRASTIVE, *GUESS_KNOWLEDGE]
    terms += [w for group in (GUESS_FUSION, GUESS_OBJECTIVES) for _, ws in group for w in ws]
    return Lexicons({"report": [(GUESS_REPORT, "report-generation")], "class": words(GUESS_CLASSES), "task": words(GUESS_TASKS)}, terms)


def guess_records(df: DataFrame, text: str) -> DataFrame:
    """A record by plain cues, each field on its own; what no cue tells is not reported, and a task is report generation by default.

    All cues of all fields are found in one pass over the text. Adds modality, train, eval_, vlm, model, klass, task,
    vision, language, fusion, objectives, rag, metrics, family; columns of these names are replaced.
    """
    lexicons, (found, hits) = _guess_lexicons(), fresh(df, "found", "hits")
    d = df.withColumn(found, lexicons.terms_in(F.col(text))).withColumn(hits, lexicons.hits(F.col(found), F.col(text)))
    there, hit = F.col(found), F.col(hits)
    cell = lambda terms: F.coalesce(F.nullif(F.array_join(in_order(there, terms), ", "), F.lit("")), F.lit(NOT_REPORTED))
    first = lambda groups: F.coalesce(*[F.when(has(there, *ws), F.lit(x)) for x, ws in groups], F.lit(NOT_REPORTED))
    yes = lambda words: F.when(has(there, *words), "Yes").otherwise(NOT_REPORTED)
    report = lexicons.any(hit, "report")
    fusion = first(GUESS_FUSION)
    objectives = F.array_join(F.array_compact(F.array(*[F.when(has(there, *ws), x) for x, ws in GUESS_OBJECTIVES])), ", ")
    models = F.transform(in_order(there, GUESS_MODELS), F.lower)
    among = lambda names: F.arrays_overlap(models, F.array(*[F.lit(x) for x in names]))
    family = (
        F.when(has(there, *GUESS_CONTRASTIVE), "Contrastive").when(among(GUESS_ENCODER_DECODER) | has(there, "cross-attention"), "Encoder–Decoder")
        .when(among(GUESS_ADAPTERED) | (fusion == "q-former"), "Adaptered LLM (V+L)").when(fusion == "single-stream", "Single-stream Transformer")
        .when(has(there, *GUESS_KNOWLEDGE), "Knowledge-augmented").otherwise(NOT_REPORTED)
    )
    return d.withColumns({
        "modality": first([("X-Ray" if "x" in k else k.upper(), (k,)) for k in GUESS_MODALITIES]), "train": cell(GUESS_DATASETS), "eval_": cell(GUESS_DATASETS), "vlm": yes(GUESS_VLM), "model": cell(GUESS_MODELS),
        "klass": F.when(report, NOT_REPORTED).otherwise(lexicons.first(hit, "class", NOT_REPORTED)), "task": F.when(report, "report-generation").otherwise(lexicons.first(hit, "task", "report-generation")),
        "vision": cell(GUESS_VISION), "language": cell(GUESS_LANGUAGE), "fusion": fusion, "objectives": F.when(objectives == "", NOT_REPORTED).otherwise(objectives),
        "rag": yes(GUESS_RAG), "metrics": cell(GUESS_METRICS), "family": family,
    }).drop(found, hits)


def any_of(low: Column, words: Sequence[str]) -> Column:
    """Whether one of the plain words occurs, in one pass."""
    return low.rlike(trie(words))


def ensure_record(df: DataFrame, context: str, strict: bool = False, datasets: Mapping[str, Sequence[str]] = v.DATASETS, vision: Mapping = v.VISION, language: Mapping = v.LANGUAGE) -> DataFrame:
    """Fill what a record lacks from its context, and with ``strict`` drop what the context has no evidence for.

    Over modality, train, eval_, paired, vlm, rag, model, klass, vision, language, fusion, family.
    """
    c, ctx = F.col, F.coalesce(F.col(context), F.lit(""))
    missing = lambda x: F.coalesce(F.trim(c(x)), F.lit("")).isin("", NOT_REPORTED)
    bank = lambda b: [(p, k) for k, ps in b.items() for p in ps]
    mined = lambda b, in_order=False: F.coalesce(F.nullif(F.array_join(all_labels(ctx, bank(b)) if in_order else F.array_sort(all_labels(ctx, bank(b))), ", "), F.lit("")), F.lit(NOT_REPORTED))
    d = df.withColumns({x: F.when(missing(x), NOT_REPORTED).otherwise(F.trim(c(x))) for x in ("modality", "train", "eval_", "paired", "vlm", "rag", "model", "klass", "vision", "language", "fusion", "family")})
    d = d.withColumn("train", F.when(missing("train"), mined(datasets)).otherwise(c("train")))
    d = d.withColumn("eval_", F.when(missing("eval_"), c("train")).otherwise(c("eval_")))
    cues = ((r"\b(chest )?x[- ]?ray|cxr\b", "X-Ray"), (r"\bmri\b", "MRI"), (r"\bct\b", "CT"), (r"\bultrasound\b", "Ultrasound"))
    by_cue = F.coalesce(*[F.when(matches(ctx, p), F.lit(m)) for p, m in cues], F.when(any_of(c("train"), list(datasets)), "X-Ray"), F.lit(NOT_REPORTED))
    d = d.withColumns({
        "modality": F.when(missing("modality"), by_cue).otherwise(c("modality")),
        "vision": F.when(missing("vision"), mined(vision, True)).otherwise(c("vision")),
        "language": F.when(missing("language"), mined(language, True)).otherwise(c("language")),
        "paired": F.when(missing("paired") & matches(ctx, r"\bimage[- ]?report pairs?\b|\bpaired\b"), "Yes").otherwise(c("paired")),
        "rag": F.when(missing("rag") & matches(ctx, v.EVIDENCE["RAG"]), "Yes").otherwise(c("rag")),
    })
    seen = (~missing("vision") & ~missing("language")) | c("family").isin("ALBEF", "BLIP", "BLIP-2", "LLaVA", "Flamingo", "CLIP") | matches(ctx, r"\bvision[- ]?language\b|\bVLM\b")
    d = d.withColumn("vlm", F.when(missing("vlm") & seen, "Yes").otherwise(c("vlm")))
    if not strict:
        return d
    own = lambda x: F.when(evidence(c(x), ctx), c(x)).otherwise(NOT_REPORTED)
    return d.withColumns({
        **{x: strict_gate(c(x), ctx) for x in ("vision", "language", "fusion")}, **{x: own(x) for x in ("family", "klass", "model")},
        "paired": F.when((c("paired") == "Yes") & ~matches(ctx, r"\b(image[- ]?report pairs?|paired)\b"), NOT_REPORTED).otherwise(c("paired")),
        "rag": F.when((c("rag") == "Yes") & ~matches(ctx, v.EVIDENCE["RAG"]), NOT_REPORTED).otherwise(c("rag")),
    })


#: How an objective of a long record is written, what it's called, and what its context must have.
OBJECTIVE_CHECKS = (
    (("itc", "contrastive"), ("itc", "contrastive"), "ITC(contrastive)"), (("itm",), ("itm", "image-text matching"), "ITM"),
    (("caption", "cross-entropy", "nll"), ("caption", "cross-entropy", "nll"), "captioning CE/NLL"), (("rl", "cider", "scst"), ("rl", "cider", "scst"), "RL(CIDEr/SCST)"),
    (("coverage",), ("coverage",), "coverage"), (("align",), ("align",), "alignment loss"),
)
METRIC_CHECKS = (("cider", "CIDEr"), ("bleu", "BLEU-4"), ("meteor", "METEOR"), ("rouge", "ROUGE-L"), ("bertscore", "BERTScore"), ("chexbert", "CheXbert-F1"), ("radgraph", "RadGraph-F1"))


def post_validate(df: DataFrame, context: str, encoders: Sequence[str], decoders: Sequence[str], families: Sequence[str], retrieval: Sequence[str], paired: Sequence[str], unpaired: Sequence[str]) -> DataFrame:
    """Hold a long record against its context: lists keep what the context has, single cells need a word of their kind, flags follow the context.

    Over datasets, objectives, metrics (arrays), primary_metric, vision, language, family, rag_used, paired_reports, is_vlm.
    A data set counts if the context has its name; that any data set's name is enough is a known defect and not reproduced.
    """
    c, low = F.col, F.lower(F.coalesce(F.col(context), F.lit("")))
    none = F.array(F.lit(NOT_REPORTED))
    or_none = lambda a: F.when(F.size(a) > 0, a).otherwise(none)
    kept = F.array_sort(F.array_distinct(F.filter("datasets", lambda x: F.contains(low, F.lower(x)))))
    said = F.transform(F.filter("objectives", lambda o: o != NOT_REPORTED), F.lower)
    has = lambda own: lambda o: any_of(o, own)
    objectives = F.array_compact(F.array(*[F.when(F.exists(said, has(own)) & any_of(low, there), F.lit(label)) for own, there, label in OBJECTIVE_CHECKS]))
    metrics = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(label)) for k, label in METRIC_CHECKS]))
    had = F.size(F.filter("metrics", lambda m: m != NOT_REPORTED)) > 0
    needs = lambda x, words: F.when((c(x) == NOT_REPORTED) | any_of(low, words), c(x)).otherwise(NOT_REPORTED)
    d = df.withColumns({
        "datasets": or_none(kept), "objectives": F.when(F.size(said) > 0, or_none(F.array_sort(objectives))).otherwise(c("objectives")),
        "metrics": F.when(had, or_none(metrics)).otherwise(c("metrics")), "vision": needs("vision", encoders), "language": needs("language", decoders), "family": needs("family", families),
        "rag_used": any_of(low, retrieval), "is_vlm": any_of(low, families) | (any_of(low, encoders) & any_of(low, decoders)),
        "paired_reports": F.when(any_of(low, paired), "true").when(any_of(low, unpaired), "false").when(F.lower("paired_reports").isin("true", "false"), c("paired_reports")).otherwise(NOT_REPORTED),
    })
    return d.withColumn("primary_metric", F.when(F.array_contains("metrics", c("primary_metric")), c("primary_metric")).otherwise(NOT_REPORTED))


def merge_sections(df: DataFrame, key: str, sections: Mapping[str, Sequence[str]], default: str = NOT_REPORTED) -> DataFrame:
    """One wide record from a struct column for each section; a section without an answer, or a field of it, gets the default."""
    return df.select(key, *[F.coalesce(F.nullif(F.trim(F.col(f"{s}.{f}").cast("string")), F.lit("")), F.lit(default)).alias(f) for s, fields in sections.items() for f in fields])


def reconcile(*answers: Column) -> Column:
    """The first answer that says something."""
    return F.coalesce(*[F.nullif(F.trim(a), F.lit("")) for a in answers], F.lit(""))
