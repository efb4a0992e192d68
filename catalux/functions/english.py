"""English words to search terms: stop words, and the Snowball English stemmer as staged SQL expressions.

The rules are written once, as SQL that Spark and DuckDB both read (``{like}`` is the engine's regular-expression match);
``stemmed`` applies them to a frame, ``stem_sql`` writes them as common table expressions. ``stem`` is the same of one word, from the same
tables, for tasks that hold very many words: as expressions they are beyond code generation. Patterns hold no look-around,
no group references and no backslashes, so that both engines' regular expressions agree. A stage reads only columns of the stages
before it, so no expression is repeated however long the chain is. Apply it to distinct words.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The stop words of the English text search configuration.
STOP_WORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves
what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while
of at by for with about against between into through during before after above below to from up down in out on off over under again further then once
here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now
""".split())  # fmt: skip

# Fixed values of the stemmer: words with a stem of their own, words that stay, words that stay after step 1a.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
#: Beginnings after which region 1 starts in any case.
LONG_STARTS = ("gener", "commun", "arsen")
STEP_2 = {
    "ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble", "lessli": "less", "tional": "tion", "alism": "al", "aliti": "al", "ation": "ate", "entli": "ent",
    "fulli": "ful", "iviti": "ive", "ousli": "ous", "abli": "able", "alli": "al", "anci": "ance", "ator": "ate", "enci": "ence", "izer": "ize", "bli": "ble",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic")

_V, _C = "[aeiouy]", "[^aeiouy]"
_REGION = f"^{_C}*{_V}+{_C}"
_SHORT = "(({like}({w}, '[^aeiouy][aeiouy][^aeiouywxY]$')) OR ({like}({w}, '^[aeiouy][^aeiouy]$')))"


def _ends(w: str, s: str) -> str:
    return f"right({w}, {len(s)}) = '{s}'"


def _cut(w: str, n: int, more: str = "") -> str:
    return f"left({w}, length({w}) - {n})" + (f" || '{more}'" if more else "")


def _first(w: str, rules: list[tuple[str, str, str]]) -> str:
    """The first rule whose suffix fits decides: its word if its condition holds, else the word as it is."""
    return "CASE " + " ".join(f"WHEN {_ends(w, s)} THEN " + (f"CASE WHEN {c} THEN {to} ELSE {w} END" if c else to) for s, c, to in rules) + f" ELSE {w} END"


def _in(region: str, w: str, n: int) -> str:
    return f"length({w}) - {n} >= {region}"


def _stages() -> list[tuple[str, str]]:
    """Column and expression of each stage; ``{word}`` is the word, the last column its stem."""
    marked = "CASE WHEN left({word}, 1) = 'y' THEN 'Y' || substr({word}, 2) ELSE {word} END"
    for v in "aeiouy":
        marked = f"replace({marked}, '{v}y', '{v}Y')"
    region = lambda of: f"length(regexp_extract({of}, '{_REGION}', 0))"
    starts = " ".join(f"WHEN left(s0, {len(s)}) = '{s}' THEN {len(s)}" for s in LONG_STARTS)
    double = "|".join(2 * c for c in "bdfgmnprt")
    step_1b = [(s, _in("r1", "s1", len(s)), _cut("s1", len(s), "ee")) for s in ("eedly", "eed")]
    step_1b += [(s, f"{{like}}({_cut('s1', len(s))}, '{_V}')", _cut("s1", len(s)) + " || '+'") for s in ("ingly", "edly", "ing", "ed")]
    step_2 = [(s, _in("r1", "s4", len(s)), _cut("s4", len(s), to)) for s, to in STEP_2.items()]
    step_2 += [("ogi", _in("r1", "s4", 3) + " AND " + _ends("s4", "logi"), _cut("s4", 1)), ("li", _in("r1", "s4", 2) + " AND {like}(s4, '[cdeghkmnrt]li$')", _cut("s4", 2))]
    step_3 = [(s, _in("r1", "s5", len(s)), _cut("s5", len(s), to)) for s, to in STEP_3.items()]
    step_3.insert(2, ("ative", _in("r2", "s5", 5), _cut("s5", 5)))
    step_4 = [(s, _in("r2", "s6", len(s)), _cut("s6", len(s))) for s in STEP_4]
    step_4.insert(14, ("ion", _in("r2", "s6", 3) + " AND {like}(s6, '[st]ion$')", _cut("s6", 3)))
    special = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SPECIAL.items())
    kept = ", ".join(f"'{w}'" for w in KEPT)
    short = _SHORT.replace("{w}", "left(s7, length(s7) - 1)")
    return [
        ("s0", marked),
        ("r1", f"CASE {starts} WHEN {{like}}(s0, '{_REGION}') THEN {region('s0')} ELSE length(s0) END"),
        ("r2", f"CASE WHEN {{like}}(substr(s0, r1 + 1), '{_REGION}') THEN r1 + {region('substr(s0, r1 + 1)')} ELSE length(s0) END"),
        ("s1", _first("s0", [("sses", "", _cut("s0", 2)), ("ied", "length(s0) > 4", _cut("s0", 2)), ("ies", "length(s0) > 4", _cut("s0", 2)), ("us", "", "s0"), ("ss", "", "s0"), ("s", f"{{like}}(s0, '{_V}.+s$')", _cut("s0", 1))])
               .replace("THEN left(s0, length(s0) - 2) ELSE s0 END", "THEN left(s0, length(s0) - 2) ELSE left(s0, length(s0) - 1) END")),
        ("s2", f"CASE WHEN s1 IN ({kept}) THEN s1 ELSE {_first('s1', step_1b)} END"),
        # a suffix that step 1b took left a mark
        ("s3", "CASE WHEN right(s2, 1) <> '+' THEN s2 WHEN {like}(s2, '(at|bl|iz)[+]$') THEN " + _cut("s2", 1, "e") + f" WHEN {{like}}(s2, '({double})[+]$') THEN " + _cut("s2", 2)
               + " WHEN r1 >= length(s2) - 1 AND " + _SHORT.replace("{w}", "left(s2, length(s2) - 1)") + " THEN " + _cut("s2", 1, "e") + " ELSE " + _cut("s2", 1) + " END"),
        ("s4", f"CASE WHEN {{like}}(s3, '.{_C}[yY]$') THEN {_cut('s3', 1, 'i')} ELSE s3 END"),
        ("s5", _first("s4", step_2)),
        ("s6", _first("s5", step_3)),
        ("s7", _first("s6", step_4)),
        ("s8", f"CASE WHEN {_ends('s7', 'e')} AND ({_in('r2', 's7', 1)} OR ({_in('r1', 's7', 1)} AND NOT {short})) THEN {_cut('s7', 1)} WHEN {_ends('s7', 'll')} AND {_in('r2', 's7', 1)} THEN {_cut('s7', 1)} ELSE s7 END"),
        ("stem", f"CASE WHEN length({{word}}) < 3 OR {{like}}({{word}}, '[0-9]') THEN {{word}} WHEN {{word}} IN ({', '.join(repr(w) for w in SPECIAL)}) THEN CASE {{word}} {special} END WHEN s1 IN ({kept}) THEN s1 ELSE replace(s8, 'Y', 'y') END"),
    ]


STAGES = _stages()


_IS_REGION, _HAS_VOWEL, _PLURAL = re.compile(_REGION), re.compile(_V), re.compile(f"{_V}.+s$")
_IS_SHORT = re.compile("[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$")
_IS_DOUBLE, _IS_Y, _HAS_DIGIT = re.compile("(" + "|".join(2 * c for c in "bdfgmnprt") + ")$"), re.compile(f".{_C}[yY]$"), re.compile("[0-9]")
_RULES_3 = [*list(STEP_3.items())[:2], ("ative", None), *list(STEP_3.items())[2:]]
_RULES_4 = [*STEP_4[:14], "ion", *STEP_4[14:]]


def stem(word: str) -> str:
    """The stem of one lower-cased word, as ``stemmed`` has it."""
    if len(word) < 3 or _HAS_DIGIT.search(word):
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = "Y" + word[1:] if word[0] == "y" else word
    for v in "aeiouy":
        w = w.replace(f"{v}y", f"{v}Y")
    start = next((x for x in LONG_STARTS if w.startswith(x)), None)
    found = _IS_REGION.search(w)
    r1 = len(start) if start else found.end() if found else len(w)
    found = _IS_REGION.search(w[r1:])
    r2 = r1 + found.end() if found else len(w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _PLURAL.search(w):
        w = w[:-1]
    if w in KEPT:
        return w
    # past and progressive forms
    if end := next((x for x in ("eedly", "eed", "ingly", "edly", "ing", "ed") if w.endswith(x)), None):
        cut = w[: -len(end)]
        if end.startswith("eed"):
            w = cut + "ee" if len(cut) >= r1 else w
        elif _HAS_VOWEL.search(cut):
            if cut.endswith(("at", "bl", "iz")):
                w = cut + "e"
            elif _IS_DOUBLE.search(cut):
                w = cut[:-1]
            else:
                w = cut + "e" if r1 >= len(cut) and _IS_SHORT.search(cut) else cut
    if _IS_Y.search(w):
        w = w[:-1] + "i"
    if end := next((x for x in STEP_2 if w.endswith(x)), None):
        w = w[: -len(end)] + STEP_2[end] if len(w) - len(end) >= r1 else w
    elif w.endswith("ogi"):
        w = w[:-1] if len(w) - 3 >= r1 and w.endswith("logi") else w
    elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] and w[-3] in "cdeghkmnrt":
        w = w[:-2]
    if rule := next((x for x in _RULES_3 if w.endswith(x[0])), None):
        end, to = rule
        w = w[: -len(end)] + (to or "") if len(w) - len(end) >= (r2 if to is None else r1) else w
    if (end := next((x for x in _RULES_4 if w.endswith(x)), None)) and len(w) - len(end) >= r2 and (end != "ion" or w.endswith(("sion", "tion"))):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _IS_SHORT.search(w[:-1]))) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stemmed(words: DataFrame, word: str = "word", stem: str = "term") -> DataFrame:
    """``words`` with the stem of a column of lower-cased words; words with a digit and those of one or two letters stay."""
    out = words
    for c, x in STAGES:
        out = out.withColumn(f"__{c}", F.expr(_named(x.format(word=word, like="regexp_like"))))
    return out.withColumnRenamed("__stem", stem).drop(*[f"__{c}" for c, _ in STAGES[:-1]])


def _named(x: str) -> str:
    """Names of stages with the prefix of ``stemmed``'s columns."""
    return re.sub(r"\b(s[0-8]|r[12])\b(?!')", r"__\1", x)


def stem_sql(source: str, name: str) -> str:
    """DuckDB: common table expressions, the last called ``name`` with columns word and term, over ``source`` with a column word."""
    parts, last = [], source
    for i, (c, x) in enumerate(STAGES):
        now = name if i == len(STAGES) - 1 else f"{name}_{c}"
        what = f"word, {x.format(word='word', like='regexp_matches')} AS term" if now == name else f"*, {x.format(word='word', like='regexp_matches')} AS {c}"
        parts.append(f"{now} AS (SELECT {what} FROM {last})")
        last = now
    return ", ".join(parts)
