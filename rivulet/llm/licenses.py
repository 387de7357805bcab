"""License scans with ordered signature rules, in DataFrame functions alone.

Rules that share a keyword and a head, which all their matches contain, are a
group.  Only the rules of groups whose keyword and head a text has run their
pattern, over the whole text, and give an interval for each match; groups come
from the rules themselves, so no rule is passed over.  Rules have a priority: an
identifier in a tag outranks a named license, that a loose mention.  A match
that lies within one of the same or a higher rank is suppressed; sorted by
start, one fold decides this with the furthest end of each rank, so nothing is
compared in pairs.  All of it happens within a row: no shuffle, no hot key.

Null text counts as empty: no words, no labels, score 0.  Texts are searched
whole, however long.  Of matches with one interval the one of the higher rank
stays, then the one with the longer label.  Repeated rows give repeated results,
an empty table an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.notices import signatures

#: Characters of words and between them, in texts whose letters are small.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]++"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: Phrases of the base and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Ranks of the rules, and how sure a match of each is.
TAG, NAMED, LOOSE = 0, 1, 2
SURE = {TAG: 1.0, NAMED: 0.9, LOOSE: 0.5}


@dataclass(frozen=True)
class Rule:
    label: str
    rank: int
    keyword: str
    pattern: str
    #: What every match contains, as a pattern that is quick to look for.
    head: str = ""


def family(label: str, names: dict[str, str], versions: tuple[str, ...] = ()) -> list[Rule]:
    """Rules of a license: its tag, each of its names (keyword and pattern) with the version, and the names alone."""
    tag = rf"spdx-license-identifier:\s*\(?{label}"
    if not versions:
        return [Rule(label, TAG, "spdx", tag + r"(?![\w.+-])"), *(Rule(label, NAMED, k, rf"\b(?:{n})(?!\w)", n) for k, n in names.items())]
    out = []
    for v in versions:
        number = v.replace(".", r"\.")
        number = rf"{v[:-2]}(?:\.0)?" if v.endswith(".0") else number
        out += [Rule(f"{label}-{v}-or-later", TAG, "spdx", rf"{tag}-{number}(?:-or-later|\+)"), Rule(f"{label}-{v}", TAG, "spdx", rf"{tag}-{number}(?:-only)?(?![\w.+-])")]
        for k, n in names.items():
            versioned = rf"\b(?:{n})[\s,(-]{{0,4}}(?:version|v\.?)?\s?{number}"
            out += [Rule(f"{label}-{v}", NAMED, k, versioned + r"(?![\w.]\d)", n), Rule(f"{label}-{v}-or-later", NAMED, k, versioned + r"[,)]?\s(?:or|and)\s(?:\(at your option\)\s)?(?:any\s)?later", n)]
    return out + [Rule(label, LOOSE, k, rf"\b(?:{n})(?!\w)", n) for k, n in names.items()]


#: Versioned licenses: each name's keyword and pattern, and the versions.
VERSIONED: dict[str, tuple[dict[str, str], tuple[str, ...]]] = {
    "gpl": ({"general": r"gnu\sgeneral\spublic\slicense", "gpl": r"(?:gnu\s)?gpl"}, ("1.0", "2.0", "3.0")),
    "lgpl": ({"general": r"gnu\s(?:lesser|library)\sgeneral\spublic\slicense", "lgpl": "lgpl"}, ("2.0", "2.1", "3.0")),
    "agpl": ({"affero": r"(?:gnu\s)?affero\sgeneral\spublic\slicense", "agpl": "agpl"}, ("1.0", "3.0")),
    "gfdl": ({"documentation": r"gnu\sfree\sdocumentation\slicense", "gfdl": "gfdl"}, ("1.1", "1.2", "1.3")),
    "cc0": ({"cc0": "cc0", "commons": r"creative\scommons\szero"}, ("1.0",)),
    "apache": ({"apache": r"apache\s(?:software\s)?license"}, ("1.0", "1.1", "2.0")),
    "mpl": ({"mozilla": r"mozilla\spublic\slicense", "mpl": "mpl"}, ("1.0", "1.1", "2.0")),
    "epl": ({"eclipse": r"eclipse\spublic\slicense", "epl": "epl"}, ("1.0", "2.0")),
    "eupl": ({"european": r"european\sunion\spublic\slicen[cs]e", "eupl": "eupl"}, ("1.0", "1.1", "1.2")),
    "cddl": ({"distribution": r"common\sdevelopment\sand\sdistribution\slicense", "cddl": "cddl"}, ("1.0", "1.1")),
    "artistic": ({"artistic": r"artistic\slicense"}, ("1.0", "2.0")),
    "ofl": ({"open font": r"(?:sil\s)?open\sfont\slicense", "ofl": "ofl"}, ("1.0", "1.1")),
    "osl": ({"open software": r"open\ssoftware\slicense", "osl": "osl"}, ("1.0", "2.0", "2.1", "3.0")),
    "afl": ({"academic": r"academic\sfree\slicense", "afl": "afl"}, ("1.1", "1.2", "2.0", "2.1", "3.0")),
    "odc-by": ({"open data": r"open\sdata\scommons\sattribution"}, ("1.0",)),
    "php": ({"php": r"php\slicense"}, ("3.0", "3.01")),
    "zpl": ({"zope": r"zope\spublic\slicense"}, ("1.1", "2.0", "2.1")),
    "lppl": ({"latex": r"latex\sproject\spublic\slicense", "lppl": "lppl"}, ("1.0", "1.1", "1.2", "1.3")),
    "cecill": ({"cecill": "cecill"}, ("1.0", "1.1", "2.0", "2.1")),
}
#: Kinds of the attribution licenses, as their full names say them, and their versions.
ATTRIBUTION = {"by": "attribution", "by-sa": r"attribution[\s-]sharealike", "by-nd": r"attribution[\s-]noderiv(?:ative)?s", "by-nc": r"attribution[\s-]noncommercial", "by-nc-sa": r"attribution[\s-]noncommercial[\s-]sharealike", "by-nc-nd": r"attribution[\s-]noncommercial[\s-]noderiv(?:ative)?s"}
ATTRIBUTION_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Licenses without versions: each name's keyword and pattern.
SINGLE: dict[str, dict[str, str]] = {
    "mit": {"mit": r"mit\slicense|mit/x11\slicense", "expat": r"expat\slicense", "permission is hereby": r"permission is hereby granted, free of charge, to any person obtaining a copy"},
    "isc": {"isc": r"isc\slicense"}, "zlib": {"zlib": r"zlib(?:/libpng)?\slicense"}, "bsl-1.0": {"boost": r"boost\ssoftware\slicense"},
    "unlicense": {"unlicen": r"unlicen[cs]e"}, "wtfpl": {"wtfpl": "wtfpl"}, "ncsa": {"illinois": r"university\sof\sillinois(?:/ncsa)?\sopen\ssource\slicense"},
    "postgresql": {"postgresql": r"postgresql\slicense"}, "python-2.0": {"python": r"python\ssoftware\sfoundation\slicense", "psf": r"psf\slicense"},
    "ruby": {"ruby": r"ruby\slicense"}, "vim": {"vim": r"vim\slicense"}, "openssl": {"openssl": r"openssl\slicense"}, "curl": {"curl": r"curl\slicense"},
    "odbl-1.0": {"open database": r"open\sdatabase\slicense", "odbl": "odbl"}, "public-domain": {"public domain": r"(?:in|into|to)\sthe\spublic\sdomain"},
    "proprietary": {"rights": r"all\srights\sreserved"},
}
CLAUSES = {"0": "zero", "1": "one", "2": "two", "3": "three", "4": "four"}


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, some hundreds: made from the families, and the hand-written signatures of license texts."""
    out = [r for label, (names, versions) in VERSIONED.items() for r in family(label, names, versions)]
    for kind, name in ATTRIBUTION.items():
        short = kind.replace("-", r"[\s-]")
        out += family(f"cc-{kind}", {"commons": rf"creative\scommons\s{name}", "cc": rf"cc[\s-]{short}"}, ATTRIBUTION_VERSIONS)
        out += [Rule(f"cc-{kind}", NAMED, "creativecommons", rf"creativecommons\.org/licenses/{kind}/")]
    for n, word in CLAUSES.items():
        out += family(f"bsd-{n}-clause", {"bsd": rf"bsd[\s-](?:{n}|{word})[\s-]clause|(?:{n}|{word})[\s-]clause\sbsd"})
    out += [Rule("bsd", LOOSE, "bsd", r"\bbsd(?:[\s-]style)?\slicense")]
    out += [Rule(label, NAMED, keyword, pattern) for label, keyword, pattern in signatures()]
    return tuple(out + [r for label, names in SINGLE.items() for r in family(label, names)])


def words(text: str) -> Column:
    """The words of a text whose letters A-Z are small."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def count_words(text: str) -> Column:
    """How many words a text has: each one, with what follows it up to the next, becomes a single letter."""
    short = F.regexp_replace(text, f"{WORD}{NOT_WORD}*+", "a")
    first = F.instr(short, "a")
    return F.when(first > 0, F.length(short) - first + 1).otherwise(F.lit(0)).cast("long")


def places(ws: Column, phrase: str) -> Column:
    """Indexes of the words at which the words of ``phrase`` stand one after another."""
    parts = phrase.split()
    at = F.sequence(F.lit(0), F.size(ws) - len(parts))
    here = lambda i: reduce(Column.__and__, [F.get(ws, i + k) == w for k, w in enumerate(parts)])
    return F.when(F.size(ws) >= len(parts), F.filter(at, here)).otherwise(F.array().cast("array<int>"))


def matches(text: str, rule: Column) -> Column:
    """(start, end, rank, label) of all matches of a rule in a text, left to right."""
    found = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    gaps = F.split(text, rule["pattern"], -1)
    pairs = F.arrays_zip(F.transform(F.slice(gaps, 1, F.size(found)), F.length).alias("gap"), F.transform(found, F.length).alias("len"))
    kind = "array<struct<start:int,end:int,rank:int,label:string>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("all"))
    add = lambda acc, p: F.struct(
        (acc["at"] + p["gap"] + p["len"]).alias("at"),
        F.concat(acc["all"], F.array(F.struct((acc["at"] + p["gap"]).alias("start"), (acc["at"] + p["gap"] + p["len"]).alias("end"), rule["rank"].alias("rank"), rule["label"].alias("label")))).alias("all"),
    )
    return F.aggregate(pairs, begin, add, lambda acc: acc["all"])


def kept(hits: Column) -> Column:
    """Distinct (rank, label) of the hits that lie within no other hit of the same or a higher rank.

    Of hits with the same interval the one with the higher rank stays, then the longer and then the earlier label.
    """
    order = lambda h: F.struct(h["start"].alias("start"), (-h["end"]).alias("far"), h["rank"].alias("rank"), (-F.length(h["label"])).alias("short"), h["label"].alias("label"))
    kind = "array<struct<rank:int,label:string>>"
    begin = F.struct(*(F.lit(-1).alias(f"e{r}") for r in SURE), F.array().cast(kind).alias("kept"))

    def add(acc: Column, h: Column) -> Column:
        end = -h["far"]
        hidden = reduce(Column.__or__, [(h["rank"] >= r) & (acc[f"e{r}"] >= end) for r in SURE])
        fresh = F.array(F.struct(h["rank"].alias("rank"), h["label"].alias("label")))
        return F.struct(
            *(F.when(~hidden & (h["rank"] == r), F.greatest(acc[f"e{r}"], end)).otherwise(acc[f"e{r}"]).alias(f"e{r}") for r in SURE),
            F.when(hidden, acc["kept"]).otherwise(F.array_union(acc["kept"], fresh)).alias("kept"),
        )

    return F.aggregate(F.array_sort(F.transform(hits, order)), begin, add, lambda acc: acc["kept"])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, own: tuple[Rule, ...] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, detections, labels and score of every text.

    detections has rank and label of the signature rules that held; labels adds
    them to the base labels.  score is how sure the surest of all is.
    """
    own = rules() if own is None else own
    groups: dict[tuple[str, str], list[Rule]] = {}
    for r in own:
        groups.setdefault((r.keyword, r.head), []).append(r)
    kind = "array<struct<label:string,rank:int,keyword:string,pattern:string>>"
    table = lambda rs: F.array(*(F.struct(F.lit(r.label).alias("label"), F.lit(r.rank).alias("rank"), F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern")) for r in rs)).cast(kind)
    has = lambda k, head: F.contains("t", F.lit(k)) & F.rlike("t", F.lit(head)) if head else F.contains("t", F.lit(k))
    chosen = F.concat(F.array().cast(kind), *(F.when(has(*g), table(rs)).otherwise(F.array().cast(kind)) for g, rs in groups.items()))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.coalesce(text, F.lit(""))).alias("t"))
    # a text that holds a phrase contains its words and, with anything between words, the phrase; places() then decides
    spread = lambda p: reduce(Column.__and__, [F.contains("t", F.lit(w)) for w in sorted(p.split(), key=len, reverse=True)]) & F.rlike("t", F.lit(f"{NOT_WORD}+".join(p.split())))
    ws = F.when(reduce(Column.__or__, map(spread, phrases)), words("t"))
    rows = rows.select("doc_id", "t", count_words("t").alias("n_words"), ws.alias("ws"), chosen.alias("chosen"))
    none = F.array().cast("array<int>")
    found = {p: F.when(F.col("ws").isNotNull(), places(F.col("ws"), p)).otherwise(none) for p in phrases}
    rows = rows.select("doc_id", "n_words", *(c.alias(f"p{i}") for i, c in enumerate(found.values())), F.when(F.size("chosen") > 0, kept(F.flatten(F.transform("chosen", lambda r: matches("t", r))))).otherwise(F.array().cast("array<struct<rank:int,label:string>>")).alias("detections"))
    spots = F.concat(*(F.col(f"p{i}") for i in range(len(found))))
    base = F.array_compact(F.array(*(F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values()))))
    sure = F.transform("detections", lambda d: reduce(lambda c, r: c.when(d["rank"] == r[0], F.lit(r[1])), list(SURE.items())[1:], F.when(d["rank"] == TAG, F.lit(SURE[TAG]))))
    return rows.select(
        "doc_id", "n_words", F.size(spots).cast("long").alias("n_base"), F.array_min(spots).cast("long").alias("first_word"), F.array_max(spots).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(base)).alias("base_labels"), "detections",
        F.array_sort(F.array_union(base, F.transform("detections", lambda d: d["label"]))).alias("labels"),
        F.greatest(F.coalesce(F.array_max(sure), F.lit(0.0)), F.when(F.size(spots) > 0, F.lit(SURE[NAMED])).otherwise(F.lit(0.0))).alias("score"),
    )
