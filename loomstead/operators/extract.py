"""A metadata record from a text by cues, with anchors where a cue alone says too little.

One pass over a text stops wherever a cue begins; all that follows looks at what stands
there: at the cue itself, and at its surroundings for anchors. Everything is
expressions within a row: no text is moved, nothing is joined or sorted, and a text
that is full of cues costs in proportion to them. "strict" looks 80 characters around
a cue, "hybrid" 140, and hybrid takes weaker cues for modality and task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.literals import inside, lead, plain_case, reach
from ..functions.names import let
from .places import NO_WORDS, around, in_parts, sums_before, up_to_words

WIDTH = {"strict": 80, "hybrid": 140}
#: A tail that may be missing and that begins behind the word's end tells nothing about whether a pattern matches.
TAIL = re.compile(r"(?<=[A-Za-z0-9])\(-[^()]*\)\?(?=\\b$)")
ANCHORED = {f: {label: [TAIL.sub("", p) for p in ps] for label, ps in cues.items()} for f, cues in {"vision": v.VISION, "language": v.LANGUAGE, "fusion": v.FUSION, "objectives": v.OBJECTIVES}.items()}
#: Stands before each cue where a text's cues are one string; in a text its place is taken by another that no pattern knows.
MARK, INSTEAD = "\x01", "\x02"


def _any(patterns: Iterable[str], before: str = "") -> str:
    return f"(?i){before}(?:{'|'.join(f'(?:{plain_case(p)})' for p in patterns)})"


def _all(cues: Mapping[str, Sequence[str]]) -> list[str]:
    return [p for ps in cues.values() for p in ps]


def _is_cue(x: Column, cues: Mapping[str, Sequence[str]]) -> Column:
    """Whether a cue begins here, not inside a match of the same pattern."""
    out = F.rlike(x["own"], F.lit(_any(_all(cues), "^")))
    for before, part in (i for p in _all(cues) for i in inside(p)):
        out = out & ~(F.rlike(x["own"], F.lit(_any([part], "^"))) & F.rlike(x["before"], F.lit(_any([rf"\b{before}"]) + r"\z")))
    return out


def _sorted(labels: Column) -> Column:
    """Joined in order of the lower-cased labels."""
    return F.array_join(F.transform(F.array_sort(F.transform(labels, lambda x: F.struct(F.lower(x).alias("l"), x.alias("x")))), lambda s: s["x"]), ", ")


def _joined(owns: Column) -> Column:
    """Cues as one string, each behind a mark; the empty string if there are none."""
    return F.coalesce(F.array_join(F.transform(owns, lambda x: F.concat(F.lit(MARK), x["own"])), ""), F.lit(""))


def marks(text: Column, patterns: Sequence[str], width: int, about: Callable[[Column], Column]) -> Column:
    """Array of what ``about`` keeps of (own, before, near) at each place where one of the patterns begins: what begins there, what stands before it, and the place's surroundings.

    Each pattern begins with a word. What a match depends on is whole unless it reaches further than ``width`` characters.
    """
    most = max(r for r in map(reach, patterns) if r <= width)

    def at(own: Column) -> Column:
        def cut(st: Column) -> Column:
            begin = F.greatest(F.lit(0), st - width)
            near, n = around(own["parts"], begin, st + width - begin, 2 * width), st - begin
            first, rest = lambda x: F.translate(F.substring(x, n + 1, F.lit(1)), *NO_WORDS), lambda x: F.translate(F.substring(x, n + 2, F.lit(most - 1)), MARK, INSTEAD)
            return let(let(near, lambda x: F.struct(F.concat(first(x), rest(x)).alias("own"), F.substring(x, F.lit(1), n).alias("before"), x.alias("near"))), about)

        # the first piece stands before the first place, and has a blank in front
        starts = sums_before(F.transform(own["pieces"], F.char_length))
        return F.transform(F.slice(starts, F.lit(2), F.size(starts)), lambda st: cut(st - 1))

    return let(up_to_words(text, patterns), lambda p: F.when(F.size(p) > 1, let(F.struct(p.alias("pieces"), in_parts(text).alias("parts")), at)))


def extract(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mode: str = "strict") -> DataFrame:
    """The sixteen columns of a record, empty where nothing is found.

    A mention of a data set is for training, for evaluation, for both, or, where neither is said nearby, for both too.
    """
    hybrid, width = mode == "hybrid", WIDTH[mode]
    modalities, tasks = (v.MODALITIES | v.MODALITIES_HYBRID, v.TASKS | v.TASKS_HYBRID) if hybrid else (v.MODALITIES, v.TASKS)
    # another modality beside a chest data set takes two patterns in strict mode, one in hybrid
    more = {m: list(ps[: 1 if hybrid else 2]) for m, ps in v.OTHER_MODALITIES.items()}
    plain = [*_all(v.FAMILIES), *_all(v.METRICS), *_all(tasks), *_all(modalities), *_all(more), *v.RAG, *v.VLM_PHRASES]
    placed = {"sets": v.DATASETS, **ANCHORED}
    d = docs.select(F.col(doc_id).cast("string").alias("File"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    near = lambda x, patterns: F.rlike(x["near"], F.lit(_any(patterns)))
    paired = {name: v.DATASETS[name] for name in v.PAIRED_DATASETS}

    def said(x: Column) -> Column:
        """The cue, and whether its surroundings say what its fields ask for."""
        of_set = _is_cue(x, v.DATASETS)
        is_paired = of_set & near(x, v.REPORT_WORDS) & (_is_cue(x, paired) | near(x, v.PAIRED_PHRASES))
        roles = F.when(of_set, F.struct(near(x, v.TRAIN_WORDS).alias("train"), near(x, v.EVAL_WORDS).alias("eval")))
        return F.struct(x["own"].alias("own"), roles.alias("roles"), is_paired.alias("paired"), *[(_is_cue(x, cues) & near(x, v.ANCHORS[f])).alias(f) for f, cues in ANCHORED.items()])

    def role(name: str) -> Column:
        return _joined(F.filter("_marks", lambda x: x["roles"].isNotNull() & (x["roles"][name] | ~(x["roles"]["train"] | x["roles"]["eval"])))).alias(name)

    def anchored(field: str) -> Column:
        return _joined(F.filter("_marks", lambda x: x[field])).alias(field)

    d = d.withColumn("_marks", marks(F.col("_text"), plain + [p for cues in placed.values() for p in _all(cues)], width, said))
    d = d.select("File", "_text", _joined(F.col("_marks")).alias("_all"), *map(role, ("train", "eval")), F.coalesce(F.exists("_marks", lambda x: x["paired"]), F.lit(False)).alias("paired"), *map(anchored, ANCHORED))

    def has_any(found: str, patterns: Sequence[str]) -> Column:
        """Whether one of the patterns is among the cues found; those whose matches have no longest look at the whole text."""
        long = [p for p in patterns if reach(p) > width]
        short = [p for p in patterns if p not in long]
        out = F.rlike(found, F.lit(_any(short, MARK))) if short else F.lit(False)
        return out | (F.rlike(found, F.lit(_any((lead(p)[0] for p in long), MARK))) & F.rlike("_text", F.lit(_any(long)))) if long else out

    def labels(found: str, cues: Mapping[str, Sequence[str]]) -> Column:
        """The labels of the cues found, in their order."""
        none = F.array().cast("array<string>")
        return F.when(F.col(found) == "", none).otherwise(F.array_compact(F.array(*[F.when(has_any(found, ps), F.lit(x)) for x, ps in cues.items()])))

    also = [F.when(F.lit(True) if len(ps) < 2 else has_any("_all", ps[1:]), F.when(has_any("_all", ps[:1]), F.lit(m))) for m, ps in more.items()]
    own = [labels("_all", cues).alias(f) for f, cues in (("family", v.FAMILIES), ("metrics", v.METRICS), ("task", tasks), ("cues", modalities))]
    d = d.select(
        "File", "paired", *own, F.when(has_any("_all", v.RAG), "Yes").otherwise("").alias("rag"), has_any("_all", v.VLM_PHRASES).alias("claims"), F.array_compact(F.array(F.lit("X-Ray"), *also)).alias("locked"),
        *[F.array_sort(labels(r, v.DATASETS)).alias(r) for r in ("train", "eval")], *[labels(f, cues).alias(f) for f, cues in ANCHORED.items()],
    )
    d = d.withColumn("modality", F.array_join(F.when((F.size("train") + F.size("eval")) > 0, F.col("locked")).otherwise(F.col("cues")), ", "))
    both = (F.size("vision") > 0) & (F.size("language") > 0)
    known = F.arrays_overlap("family", F.array(*map(F.lit, v.VLM_FAMILIES)))
    d = d.withColumn("vlm", F.when(known | (F.col("claims") & both), "Yes").otherwise(""))
    has = F.array_contains
    klass = (
        F.when(F.col("vlm") == "Yes", "VLM (multimodal)")
        .when(has("vision", "CNN") & (has("language", "Transformer") | has("language", "BERT")), "CNN+Transformer")
        .when((has("vision", "ViT") | has("vision", "CLIP")) & has("language", "Transformer"), "Encoder–Decoder")
        .otherwise("")
    )
    columns = {
        "File": F.col("File"), "Modality": F.col("modality"), "Datasets (train)": F.array_join("train", ", "), "Datasets (eval)": F.array_join("eval", ", "), "Paired": F.when(F.col("paired"), "Yes").otherwise(""),
        "VLM?": F.col("vlm"), "Model": _sorted(F.col("family")), "Class": klass, "Task": F.array_join("task", ", "), "Vision Enc": _sorted(F.col("vision")), "Lang Dec": _sorted(F.col("language")), "Fusion": _sorted(F.col("fusion")),
        "Objectives": _sorted(F.col("objectives")), "Family": _sorted(F.col("family")), "RAG": F.col("rag"), "Metrics(primary)": _sorted(F.col("metrics")),
    }
    return d.select(*[c.alias(n) for n, c in columns.items()])
