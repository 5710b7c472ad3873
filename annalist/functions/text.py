"""Text functions as column expressions; all of them stay in generated JVM code or in array functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no keywords.
STOP_WORDS = (
    "a about after again all also am an and any are as at be because been before being between both but by can could did do does doing for "
    "from get had has have having he her here hers him his how i if in into is it its just let like may me might more most must my need no "
    "not of on or our ours out over please should so some such than that the their theirs them then there these they this those to too under up us "
    "use using very want was we were what when where which who why will with would you your yours"
).split()

# Phrase patterns of speech acts, with confidence.
QUESTION_FORM = (r"[?？]$", r"^(who|what|when|where|why|how|can|could|would|should|is|are|do|does|did)\b")
SPEECH_ACTS = {
    "question": (0.99, QUESTION_FORM),
    "request": (0.98, (r"\b(i['’]?d|i would) like\b", r"\bplease\b", r"\b(can|could|would) you\b", r"\blet['’]?s\b", r"\bkeep going\b", r"\bcontinue\b")),
    "constraint": (0.96, (r"\bmust( not)?\b", r"\b(do not|don['’]?t|cannot|can['’]?t|should not|shouldn['’]?t)\b", r"\b(required|requirement|required to)\b", r"\b(limited|restricted) to\b", r"\bonly\b")),
    "rejection": (0.97, (r"\b(i do not|i don['’]?t) want\b", r"\b(remove|get rid of|reject|drop)\b", r"\b(does not|doesn['’]?t|is not|isn['’]?t) work\b", r"^(no|nope)\b", r"\brather than\b")),
    "acceptance": (0.94, (r"^(yes|yep|yeah|great|correct|exactly)\b", r"\b(that['’]?s right|looks good|go with|approved)\b")),
    "proposal": (0.88, (r"\bwe should\b", r"\b(could|might) be\b", r"\bi propose\b", r"\blet['’]?s\b", r"\bhow about\b")),
    "decision": (0.93, (r"\b(we decided|the decision is|we will use|we['’]?ll use|go with)\b", r"\buse .+ instead\b", r"\bshould be (the|our|a)\b")),
    "status": (0.90, (r"\b(merged|deployed|implemented|fixed|completed|done|working|broken|failing|failed)\b",)),
    "rationale": (0.86, (r"^(because|since)\b", r"\bthe reason (is|was)\b", r"\bso that\b")),
    "correction": (0.86, (r"^(actually|rather|instead)\b", r"\bnot .+ but\b", r"\bi mean\b")),
}
MODALITY = (
    ("required", (r"\b(must|required|needs? to|has to|have to)\b",)),
    ("desired", (r"\b(i['’]?d like|i would like|want to|we should|should be)\b",)),
    ("possible", (r"\b(could|might|may|possibly|perhaps)\b",)),
    ("future", (r"\b(will|we['’]?ll|going to)\b",)),
)
NEGATION = (r"\b(not|no|never|cannot|can['’]?t|do not|don['’]?t|does not|doesn['’]?t|is not|isn['’]?t|must not)\b",)
URL = r"https?://[^\s<>{}\[\]\"']+"

WORD = r"[\p{L}\p{N}]+"
KEYWORD = r"[\p{L}\p{N}][\p{L}\p{N}_-]*"


def _stability() -> tuple[str, str]:
    """Two classes of characters: those below U+0250 that NFKC leaves alone, and all that it may change or join with the one before.

    Of those beyond the first plane, pictographs are left alone.
    """
    second = {d[1] for c in range(0x10000) if len(d := unicodedata.decomposition(chr(c)).split()) == 2 and not d[0].startswith("<")}

    def moves(c: int) -> bool:
        return 0x1160 <= c <= 0x11FF or bool(unicodedata.combining(chr(c))) or f"{c:04X}" in second or not unicodedata.is_normalized("NFKC", chr(c))

    def written(codes: list[int]) -> str:
        ranges: list[list[int]] = []
        for c in codes:
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
        return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)

    plane = [c for c in range(0x80, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    odd = [c for c in plane if moves(c)]
    head = [*range(0x80), *(c for c in plane if c < 0x250 and c not in set(odd[:500]))]
    return f"[{written(head)}]+", f"[{written(odd)}\\x{{10000}}-\\x{{1F2FF}}\\x{{1FB00}}-\\x{{10FFFF}}]"


STABLE, UNSTABLE = _stability()


def nfkc(text: Column) -> Column:
    """Compatibility composition (NFKC); null as empty. Texts without a character that it may change stay as they are, in the JVM.

    Others are normalised in Arrow batches; texts that need nothing are sent there as null.
    """

    @F.pandas_udf("string")
    def composed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    plain = F.coalesce(text, F.lit(""))
    # the long class is tried on what is left of a text without its plain letters
    return F.coalesce(composed(F.when(plain.rlike(r"[^\x00-\x7F]") & F.regexp_replace(plain, STABLE, "").rlike(UNSTABLE), plain)), plain)


def terms(text: Column, pattern: str = WORD) -> Column:
    """Words of letters and digits of any script, lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


# Characters that a query's terms are made of, for code and for messages.
CODE_QUERY, CHAT_QUERY = r"[A-Za-z0-9_./:-]+", r"[\w./:@-]+"


def query_terms(query: str | None, pattern: str = CHAT_QUERY) -> list[str]:
    """What a typed query asks for: its terms, any of which may match, each as the words that it holds in a row.

    Only for code queries is the pattern ASCII; others are brought to NFKC first.
    """
    line = query or "" if pattern == CODE_QUERY else unicodedata.normalize("NFKC", query or "")
    words = (re.findall(r"[^\W_]+", t.lower()) for t in re.findall(pattern, line))
    return list(dict.fromkeys(" ".join(w) for w in words if w))


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def keywords(text: Column, most: int = 24) -> Column:
    """The first distinct words of two or more characters that are no stop words, in order."""
    words = F.array_distinct(F.filter(terms(nfkc(text), KEYWORD), lambda w: (F.length(w) >= 2) & ~F.array_contains(F.lit(list(STOP_WORDS)), w)))
    return F.slice(words, 1, most)


def _holds(text: Column, patterns: Sequence[str]) -> Column:
    r"""rlike with word boundaries between ASCII words, as the patterns mean them; Java's own depend on its version.

    Patterns that begin at a word (\b), at the front (^) or elsewhere are three searches: the first steps over word
    characters without trying a single alternative, and the second looks at one place only.
    """
    kinds: dict[str, list[str]] = {"word": [], "front": [], "other": []}
    for p in patterns:
        kind, skip = ("word", 2) if p.startswith(r"\b") else ("front", 1) if p.startswith("^") else ("other", 0)
        kinds[kind].append(p[skip:].replace(r"\b", r"(?!\w)"))
    heads = {"word": (F.concat(F.lit(" "), text), r"\W"), "front": (text, "^"), "other": (text, "")}
    found = [heads[k][0].rlike(f"{heads[k][1]}(?:{'|'.join(ps)})") for k, ps in kinds.items() if ps]
    return reduce(lambda a, b: a | b, found)


def modality(text: Column) -> Column:
    low, out = F.lower(nfkc(text)), None
    for name, patterns in MODALITY:
        out = F.when(_holds(low, patterns), name) if out is None else out.when(_holds(low, patterns), name)
    return out.otherwise("asserted")


def polarity(text: Column) -> Column:
    return F.when(_holds(F.lower(nfkc(text)), NEGATION), "negative").otherwise("positive")


def speech_acts(text: Column) -> Column:
    """All acts of a text as array<struct<kind,confidence>>."""
    low = F.trim(F.lower(nfkc(text)))
    return F.array_compact(F.array(*(F.when(_holds(low, p), F.struct(F.lit(k).alias("kind"), F.lit(c).alias("confidence"))) for k, (c, p) in SPEECH_ACTS.items())))


def urls(text: Column) -> Column:
    """The URLs of a text without trailing punctuation."""
    return F.transform(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?)]+$", ""))


def without_query(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def language_of_path(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.rlike(r"\.(tsx?|mts|cts)$"), "typescript").when(low.rlike(r"\.(jsx?|mjs|cjs)$"), "javascript").when(low.rlike(r"\.cljs$"), "clojurescript").when(low.rlike(r"\.(cljc?|bb)$"), "clojure").when(low.rlike(r"\.py[iw]?$"), "python")


def skip_reason(path: Column, n_bytes: Column, most: int = 10 << 20) -> Column:
    """Why a file is not analysed, or null."""
    low = F.lower(path)
    return F.when(low.rlike(r"(^|/)(node_modules|vendor|third_party)(/|$)"), "vendored").when(low.rlike(r"(^|/)generated(/|$)|\.generated\.|\.gen\."), "generated").when(language_of_path(path).isNull(), "unsupported-language").when(n_bytes > most, "oversized")


# Characters that may close a sentence after its end mark.
CLOSERS = r"[\"'’”)\]}」』】》]*"


def sentences(text: Column) -> Column:
    """Trimmed sentences: they end at line breaks, at . ? ! before white space, and at full-width marks."""
    marked = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), f"([.?!]{CLOSERS})\\s", "$1\n"), f"([。？！]{CLOSERS})", "$1\n")
    return F.filter(F.transform(F.split(marked, "[\r\n]+"), F.trim), lambda s: s != "")


def compact(text: Column, most: int = 160) -> Column:
    """One line, cut with an ellipsis."""
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.substring(line, 1, most - 1), F.lit("…")))


def _folds() -> tuple[str, str]:
    """Latin letters with marks and what they are without: canonical decomposition of three blocks, as long as one character stays."""
    pairs = []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(bare) == 1 and bare != c:
            pairs.append((c, bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """Lower case without diacritics: Latin letters by table, loose marks are dropped."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), *_folds()), r"\p{M}", "")


def count_of(tokens: Column, phrase: str) -> Column:
    """How often a phrase (words joined by a space) stands in tokens as consecutive ones; occurrences may overlap."""
    words = phrase.split(" ")
    if len(words) == 1:
        return F.size(F.filter(tokens, lambda w: w == words[0]))
    line = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return F.regexp_count(line, F.lit(f"(?= \\Q{phrase}\\E )"))


def truncated(text: Column, tokens: int, suffix: str = "…") -> Column:
    """The text if its estimate is at most tokens, else its longest prefix of whole characters that leaves room for suffix, and suffix."""
    return truncated_bytes(text, 4 * tokens, suffix)


def truncated_bytes(text: Column, most: int | Column, suffix: str = "…") -> Column:
    """The text if it has at most so many UTF-8 bytes, else its longest prefix of whole characters that leaves room for suffix, and suffix."""
    limit = most if isinstance(most, Column) else F.lit(most)
    room = F.greatest(F.lit(0), limit - len(suffix.encode()))
    raw = text.cast("binary")

    def inner(at: Column) -> Column:  # is that byte (from 1) inside a character?
        return F.conv(F.hex(F.substring(raw, at, F.lit(1))), 16, 10).cast("int").between(128, 191)

    cut = F.when(~inner(room + 1), room).when(~inner(room), room - 1).when(~inner(room - 1), room - 2).otherwise(room - 3)
    short = F.concat(F.substring(raw, F.lit(1), F.greatest(F.lit(0), cut)).cast("string"), F.lit(suffix))
    return F.when(F.octet_length(text) <= limit, text).otherwise(short)


def windows(text: Column, size: int = 16 << 10, overlap: int = 1 << 10) -> Column:
    """Byte windows as array<struct<ordinal,start,end>>: each starts size - overlap after the one before, the last ends with the text."""
    n = F.octet_length(F.coalesce(text, F.lit(""))).cast("long")
    last = F.greatest(F.lit(0), F.ceil((n - size) / (size - overlap))).cast("long")
    return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.struct(i.alias("ordinal"), (i * (size - overlap)).alias("start"), F.least(n, i * (size - overlap) + size).alias("end")))


# Patterns of packages and paths.
PACKAGE = r"(?i)(^|[^\p{L}\p{N}_])(@[a-z0-9][a-z0-9._-]*/[a-z0-9][a-z0-9._-]*)"
PATH = r"(^|[\s`'\"(])((?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+\.[A-Za-z0-9]{1,12})"


def packages(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PACKAGE), F.lit(2))


def paths(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATH), F.lit(2))


def repositories(text: Column, host: str = "github.com") -> Column:
    """owner/name of the repositories that the URLs of a text point to."""
    at = F.transform(urls(text), lambda u: F.regexp_extract(u, rf"(?i)^https?://\Q{host}\E/+([^/?#]+/+[^/?#]+)", 1))
    return F.transform(F.filter(at, lambda r: r != ""), lambda r: F.regexp_replace(F.regexp_replace(r, "/+", "/"), r"\.git$", ""))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def known_names(text: Column, registry: Mapping[str, tuple[str, str, Sequence[str]]]) -> Column:
    """The names of a registry (key: kind, label, names) that stand in a text as whole words, as array<struct<kind,label,key>> in order.

    The longest name at a place wins, of equal ones that of the smaller key; what follows may not overlap it. Case does not count.
    """
    of = "array<struct<kind:string,label:string,key:string>>"
    names: dict[str, str] = {}
    for key in sorted(registry):
        for name in registry[key][2]:
            if name:
                names.setdefault(name.lower(), key)
    if not names:
        return F.array().cast(of)
    words = "|".join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n)))
    found = F.regexp_extract_all(text, F.lit(rf"(?iu)(?<![\p{{L}}\p{{N}}_-])(?:{words})(?![\p{{L}}\p{{N}}_-])"), F.lit(0))
    table = F.create_map(*(x for n, k in names.items() for x in (F.lit(n), F.struct(F.lit(registry[k][0]).alias("kind"), F.lit(registry[k][1]).alias("label"), F.lit(k).alias("key")))))
    return F.coalesce(F.array_compact(F.transform(found, lambda n: F.try_element_at(table, F.lower(n)))), F.array().cast(of))


def snippet(text: Column, query: Sequence[str], words: int = 18) -> Column:
    """The window of so many words that holds most of the query's terms, the first of equal ones, with hits in brackets.

    Windows begin at a hit, or earlier where the text would end too soon; without a hit it is the beginning.
    """
    split = F.filter(F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), " "), lambda w: w != "")
    asked = F.lit([q.lower() for q in query])
    marked = F.transform(split, lambda w: F.struct(w.alias("w"), F.array_intersect(terms(w), asked).alias("h")))

    def shown(m: Column) -> Column:
        held = lambda i: F.size(F.array_distinct(F.flatten(F.transform(F.slice(m, i + 1, words), lambda x: x["h"]))))
        best = F.array_max(F.transform(m, lambda x, i: F.when(F.size(x["h"]) > 0, F.struct(held(i).alias("n"), (-i).alias("at")))))
        at = F.greatest(F.lit(0), F.least(F.coalesce(-best["at"], F.lit(0)), F.size(m) - words))
        return bind(at, lambda a: F.concat(
            F.when(a > 0, "… ").otherwise(""),
            F.array_join(F.transform(F.slice(m, a + 1, words), lambda x: F.when(F.size(x["h"]) > 0, F.concat(F.lit("["), x["w"], F.lit("]"))).otherwise(x["w"])), " "),
            F.when(a + words < F.size(m), " …").otherwise(""),
        ))

    return bind(marked, shown)


def entities(text: Column, registry: Mapping[str, tuple[str, str, Sequence[str]]] | None = None) -> Column:
    """All references of a text as array<struct<kind,label,key>>: known names, urls, repositories, packages, paths."""
    low = {"repository", "package"}

    def of(kind: str, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("label"), F.concat(F.lit(f"{kind}:"), F.lower(x) if kind in low else x).alias("key")))

    return F.array_distinct(F.concat(known_names(text, registry or {}), of("url", urls(text)), of("repository", repositories(text)), of("package", packages(text)), of("path", paths(text))))


def clean_url(url: Column, hosts: list[str]) -> Column:
    """Origin and path of an https URL on one of the hosts; null otherwise."""
    host = F.lower(F.regexp_extract(url, r"^https://([^/?#:@]+)(?=[/?#]|$)", 1))
    return F.when(host.isin(hosts), F.regexp_replace(url, r"[?#].*$", ""))


def spans(text: Column) -> Column:
    """Sentences with their UTF-8 byte ranges as array<struct<text,start,end>>; the same cuts as sentences().

    Cuts have no width, so running sums of piece lengths are offsets. At most nine closers follow an end mark. A fold
    copies what it has gathered in each step, so pieces are folded in blocks, and the blocks' starts once over all.
    """
    mark = CLOSERS.removesuffix("*")
    cuts = rf"(?<=[.?!]{mark}{{0,9}})(?=\s)|(?<=[。？！]{mark}{{0,9}})(?!{mark})|(?<=[\r\n])|(?=[\r\n])"
    size, whole = 128, F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<text:string,start:bigint,end:bigint>>")

    def step(acc: Column, piece: Column) -> Column:
        body = F.regexp_replace(piece, r"^\s+|\s+$", "")
        lead = F.octet_length(piece) - F.octet_length(F.regexp_replace(piece, r"^\s+", ""))
        a = acc["at"] + lead
        s = F.struct(body.alias("text"), a.alias("start"), (a + F.octet_length(body)).alias("end"))
        return F.struct((acc["at"] + F.octet_length(piece)).alias("at"), F.when(body == "", acc["out"]).otherwise(F.array_append(acc["out"], s)).alias("out"))

    def located(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p)))
        first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        starts = F.aggregate(sizes, first, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]
        return F.flatten(F.zip_with(blocks, starts, lambda b, at: F.aggregate(b, F.struct(at.alias("at"), none.alias("out")), step)["out"]))

    blocks = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / size).cast("int")), lambda i: F.slice(p, i * size + 1, size))
    return bind(bind(F.split(whole, cuts), blocks), located)
