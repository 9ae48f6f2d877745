"""LaTeX rules that regular expressions can state, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds, names and abbreviations that the record formats and the label rules agree on.
KINDS = ("theorem", "lemma", "definition", "proposition", "example", "remark", "proof", "corollary", "assumption")
PLURALS = {k: "corollaries" if k == "corollary" else k + "s" for k in KINDS}
ALIASES = {
    "theorem": ("thm", "thma", "thmb"), "lemma": ("lem", "lema", "lemb"), "definition": ("def", "defn", "dfn"), "proposition": ("prop", "propo"),
    "example": ("ex", "exa", "exmp"), "remark": ("rmk", "rem"), "corollary": ("cor", "corol"), "assumption": ("assump", "assum"), "proof": ("pf",),
}
STEMS = {"theorem": ("theorem",), "lemma": ("lemma",), "definition": ("definition",), "proposition": ("proposition", "prop"), "example": ("example",), "remark": ("remark",), "proof": ("proof",), "corollary": ("corollary", "corol"), "assumption": ("assumption", "assump", "assum")}
GRAPH_KINDS = ("theorem", "lemma", "proposition", "corollary", "claim", "definition", "example", "remark", "assumption")
# Tried in this order where a name contains several.
GRAPH_ABBREVIATIONS = {
    "theorem": ("thm", "thmx", "thrm", "theo"), "lemma": ("lem", "lmm", "lma", "lm"), "proposition": ("prop", "propo", "propos", "prp"), "corollary": ("cor", "coro", "corol", "crl"),
    "remark": ("rmk", "rem"), "definition": ("defn", "defi", "dfn", "def"), "example": ("eg", "ex", "exa", "exmp"), "assumption": ("ass", "asp", "assum"),
}
GRAPH_CONTAINED = (*GRAPH_KINDS, "proof")
REF_COMMANDS = ("ref", "cref", "Cref", "autoref", "nameref", "namecref", "eqref")
PROOF_TARGETS = ("theorem", "lemma", "proposition", "corollary", "claim")


def graph_plural(kind: str) -> str:
    return "corollaries" if kind == "corollary" else kind + "s"


GRAPH_NAMES = tuple(n for k in GRAPH_KINDS for n in (k, graph_plural(k)))
# How documents, theorems, declarations and labels are written.
BEGIN_DOCUMENT = r"(?i)\\begin\s*\{\s*document\s*\}"
END_DOCUMENT = r"(?i)\\end\s*\{\s*document\s*\}"
DOCUMENT_CLASS = r"(?i)\\documentclass\b"
THEOREM_ENV = r"(?i)\\begin\s*\{\s*(theorem|thm)\s*\*?\s*\}"
NEWTHEOREM = r"(?i)\\newtheorem\*?\s*\{([A-Za-z@]+)\}\s*(?:\[[^\]]*\]\s*)?\{([^}]+)\}"
LABEL = r"\\label\{([^}]+)\}"


def without_comments(text: Column, rule: str = "parity") -> Column:
    """Text without comments. parity: an odd number of backslashes protects the sign. escaped: one backslash before it
    does. lines: escaped, after all line ends became line feeds."""
    if rule == "parity":
        return F.regexp_replace(text, r"(?m)(?<!\\)((?:\\\\)*)%.*$", "$1")
    if rule == "lines":
        text = F.regexp_replace(F.regexp_replace(text, r"\r\n|[\r\x0B\f\x1C-\x1E\x85\u2028\u2029]", "\n"), r"\n\z", "")
    elif rule != "escaped":
        raise ValueError("rule is parity, escaped or lines")
    return F.regexp_replace(text, r"(?<!\\)%[^\n]*", "")


def without_forgotten(text: Column) -> Column:
    """Text without forget blocks, also where taking one out forms another (up to three times)."""
    return reduce(lambda t, _: F.regexp_replace(t, r"(?s)\\forget\b.*?\\forgotten\b", ""), range(3), text)


def document_body(text: Column) -> Column:
    """What stands between the document's begin and its end, or all of it without a begin."""
    body = F.regexp_replace(text, r"(?is)^.*?\\begin\s*\{\s*document\s*\}", "")
    return F.when(text.rlike(BEGIN_DOCUMENT), F.regexp_replace(body, r"(?is)\\end\s*\{\s*document\s*\}.*$", "")).otherwise(text)


def root_score(text: Column) -> Column:
    """How likely a file is the root of its paper."""
    plain = without_comments(text)
    points = [F.when(plain.rlike(p), n).otherwise(0) for p, n in ((DOCUMENT_CLASS, 1000), (BEGIN_DOCUMENT, 200), (END_DOCUMENT, 50))]
    return sum(points, F.least(F.floor(F.length(text) / 1000), F.lit(200))).cast("long")


def display_kind(display: Column) -> Column:
    """Kind named in a display text, the first of KINDS that it contains."""
    letters = F.regexp_replace(F.lower(display), "[^a-z ]+", " ")
    return reduce(lambda rest, k: F.when(letters.contains(k), k).otherwise(rest), reversed(KINDS), F.lit(None).cast("string"))


def env_kind(env: Column, display: Column | None = None) -> Column:
    """Kind of an environment: by its display text, by alias, by name, by the name's beginning, else the name itself."""
    base = F.lower(F.trim(F.regexp_replace(env, r"\*$", "")))
    by_stem = base
    for kind in reversed(KINDS):
        for stem in reversed(STEMS[kind]):
            by_stem = F.when(base.startswith(stem), kind).otherwise(by_stem)
    named = reduce(lambda rest, k: F.when(base.isin(*ALIASES[k]), k).otherwise(rest), KINDS, by_stem)
    return named if display is None else F.coalesce(display_kind(display), named)


def starred(env: Column) -> Column:
    return env.endswith("*")


def letters_of(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z]+", "")


def graph_display_kind(display: Column) -> Column:
    """Kind whose name or plural is the longest one contained in the display's letters."""
    own = letters_of(display)
    names = [(n, k) for k in GRAPH_KINDS for n in (k, graph_plural(k))]
    ranked = sorted(names, key=lambda x: -len(x[0]))
    return reduce(lambda rest, x: F.when(own.contains(x[0]), x[1]).otherwise(rest), reversed(ranked), F.lit(None).cast("string"))


def graph_env_kind(env: Column, inferred: Column | None = None) -> Column:
    """Kind of a graph environment: inferred, named, abbreviated, containing a kind, containing an abbreviation, else itself."""
    low, own = F.lower(env), letters_of(env)
    out = low
    for kind, shorts in reversed(GRAPH_ABBREVIATIONS.items()):
        out = F.when(reduce(lambda x, y: x | y, [own.contains(s) for s in shorts]), kind).otherwise(out)
    for kind in reversed(GRAPH_CONTAINED):
        out = F.when(own.contains(kind), kind).otherwise(out)
    for kind in GRAPH_KINDS:
        out = F.when(own.isin(*GRAPH_ABBREVIATIONS.get(kind, ("",))), kind).otherwise(out)
    for kind in GRAPH_KINDS:
        out = F.when(low.isin(kind, graph_plural(kind)), kind).otherwise(out)
    return out if inferred is None else F.coalesce(inferred, out)


def ref_pattern(extra: tuple[str, ...] = ()) -> str:
    names = dict.fromkeys([*REF_COMMANDS, *[c for c in extra if c]])
    return r"\\(?:" + "|".join(names) + r")\s*\{([^}]*)\}"


def refs(text: Column, extra: tuple[str, ...] = ()) -> Column:
    """Labels that a text refers to, each once, in order."""
    groups = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ref_pattern(extra)), F.lit(1))
    parts = F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda p: F.trim(p))))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def labels(text: Column) -> Column:
    """All labels of a block, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(LABEL), F.lit(1)), lambda x: F.trim(x)), lambda x: x != ""))


def first_label(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(LABEL), F.lit(1))
    return F.trim(F.get(found, 0))


# Full case folding, by rule: characters that fold to one other, and those that fold to several.
_FOLDS = {chr(c): chr(c).casefold() for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).casefold() != chr(c)}
_ONE = {c: f for c, f in _FOLDS.items() if len(f) == 1}
_SEVERAL = {c: f for c, f in _FOLDS.items() if len(f) > 1}


def casefolded(text: Column) -> Column:
    """Full case folding. Only texts with a character that folds to several go through it character by character."""
    one = F.translate(text, "".join(_ONE), "".join(_ONE.values()))
    several = F.create_map(*[F.lit(x) for pair in _SEVERAL.items() for x in pair])
    spelled = F.array_join(F.transform(F.split(one, ""), lambda c: F.coalesce(F.element_at(several, c), c)), "")
    return F.when(one.rlike(f"[{''.join(_SEVERAL)}]"), spelled).otherwise(one)


def folded_label(label: Column, lowercase: bool = True) -> Column:
    return casefolded(label) if lowercase else label


def canonical_label(label: Column) -> Column:
    return F.regexp_replace(F.lower(label), "[^a-z0-9]+", "")


def label_tokens(label: Column) -> Column:
    """Parts of a label between separators and between a small letter and a capital, as a set."""
    apart = F.regexp_replace(label, "([a-z0-9])([A-Z])", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(apart), r"[:_/.\- ]+"), lambda x: F.trim(x) != ""))


def newtheorems(text: Column) -> Column:
    """Array of structs (env, display) of theorem declarations, in order."""
    envs, displays = (F.regexp_extract_all(text, F.lit(NEWTHEOREM), F.lit(g)) for g in (1, 2))
    return F.zip_with(envs, displays, lambda e, d: F.struct(F.trim(e).alias("env"), F.trim(d).alias("display")))
