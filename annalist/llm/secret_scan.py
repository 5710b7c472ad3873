"""Secret scanning with a random forest against false positives, in DataFrame functions only.

Candidates are whole values that = or : joins to a secret cue, quoted or up to the next space, of any
length and characters, and runs of at least eight letters, digits and +/_- that have a digit in them or
start with a known prefix. Each is described by its length, its character classes and transitions
between them, how much of it words of a dictionary cover, whether it looks like code or a sentence, the
document's path and the words beside it. A random forest, fitted on labelled findings,
decides which candidates are secrets; it is evaluated as a fold over literal arrays, so scanning
stays in the JVM and needs no shuffle.

The dictionary is a sorted list of words; `vocabulary` reads one from a public tokenizer's pieces, with a path as its
parameter. A character is covered if it lies in a dictionary word of four to MOST_LETTERS letters that the
candidate, in lower case, holds anywhere.

`train` accepts any table of labelled findings and fits those that are not held out, at most max_rows, those with the smallest
hash. `findings` makes such a table from a rule, since no table here labels secrets; a quarter of it is held out.

Defined results: null text or path = empty; a text without candidates has no secrets and is left as it
is; repeated rows are scanned row by row; an empty table gives no rows; extra columns are kept by
`redact` and ignored by `scan`. Spans count code points, ends exclusive.
"""

from __future__ import annotations

import random
import string
from collections.abc import Sequence
from dataclasses import dataclass, replace
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused, whole

PREFIX = r"(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk-|rk_live_|AIza|ya29|eyJ|npm_|pypi-)"
CUED = r"(?i:passw|pwd|secret|token|api.?key|auth(?!or)|credential|private|access.?key|bearer)[^\n=:]{0,12}[=:][ \t]{0,3}"
CANDIDATE = (
    rf"(?<=[\"'])(?:(?<={CUED}\")[^\"\n]+(?=\")|(?<={CUED}')[^'\n]+(?='))"
    rf"|(?<=[=:][ \t]{{0,3}})(?<={CUED})[^\s\"'=:.,;)\]}}<>](?:[^\s\"<>]*[^\s\"'.,;:)\]}}<>])?"
    rf"|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9]|{PREFIX})[A-Za-z0-9+/_-]{{8,}}+={{0,2}}"
)
MARK = "[SECRET]"
LEAST_LETTERS, MOST_LETTERS = 4, 10

# Cues in Java regular expressions.
KNOWN = "^" + PREFIX
SECRET_CUES = r"(?i)(passw|pwd|secret|token|api.?key|apikey|auth|credential|private|access.?key|bearer)[^\n]{0,12}$"
OTHER_CUES = r"(?i)(commit|revision|sha|md5|checksum|digest|hash|uuid|etag|version|order|invoice|phone|tel|card|account|isbn|build|request|trace|session.?id|page|item)[^\n]{0,12}$"
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|your|placeholder|xxxx|0000|1234|test|fake|redacted"
PAIRS = r"th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce"
CODE = r"[(){}\[\]<>$]|^[A-Za-z_]+(\.[A-Za-z_]+)+$|://"
SENTENCE = r"(?i)\b(the|a|an|is|are|be|must|at|of|to|in|for|your|not|please|enter|and|or|was|with|this|can)\b"
TEST_PATH = r"(?i)(^|[/_.-])(tests?|spec|examples?|docs?|fixtures?|mocks?|samples?)([/_.-]|$)"


def vocabulary(model: str, most: int = 3000) -> tuple[str, ...]:
    """The first most lower-case ASCII words of LEAST_LETTERS to MOST_LETTERS letters that are whole pieces of a sentencepiece model, sorted."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=model)
    words = (pieces.id_to_piece(k)[1:] for k in range(pieces.get_piece_size()) if pieces.id_to_piece(k)[0] == "▁")
    return tuple(sorted(islice((w for w in words if w.isascii() and w.isalpha() and w.islower() and LEAST_LETTERS <= len(w) <= MOST_LETTERS), most)))


def _literal(values: Sequence, kind: str = "string") -> Column:
    """A literal array, folded by the optimiser from one string: thousands of values are slow to hand over one by one."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def covered(c: Column, dictionary: Sequence[str]) -> Column:
    """The share of c's characters that words of the dictionary cover; longer words are laid out first, equally long ones in order."""
    if not dictionary:
        return F.lit(0.0)
    low, mark = F.lower(c), "\x01"
    starts = lambda run, size: F.filter(F.sequence(F.lit(1), F.length(run)), lambda k: k <= F.length(run) - size + 1)
    pieces = lambda run: F.flatten(F.transform(F.sequence(F.lit(LEAST_LETTERS), F.lit(MOST_LETTERS)), lambda size: F.transform(starts(run, size), lambda k: F.substring(run, k, size))))
    runs = F.regexp_extract_all(low, F.lit(f"[a-z]{{{LEAST_LETTERS},}}"), F.lit(0))
    held = F.array_sort(F.transform(F.array_intersect(F.flatten(F.transform(runs, pieces)), _literal(dictionary)), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    laid = F.aggregate(held, F.translate(low, mark, " "), lambda s, h: F.replace(s, h["w"], F.repeat(F.lit(mark), -h["n"])))
    return F.lit(1.0) - F.length(F.translate(laid, mark, "")).cast("double") / F.greatest(F.length(c), F.lit(1))


def features(c: Column, before: Column, after: Column, path: Column, dictionary: Sequence[str] = ()) -> Column:
    """The features of candidates as an array of doubles."""
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    low = F.lower(c)
    left = F.right(before, F.lit(40))
    flag = lambda x: F.when(x, F.lit(1.0)).otherwise(F.lit(0.0))
    share = lambda pattern, of=c: F.length(F.regexp_replace(of, pattern, "")).cast("double") / n
    parts = (
        n,
        share("[^0-9]"),
        share("[^A-Z]"),
        share("[^a-z]"),
        share("[A-Za-z0-9]"),
        F.size(F.array_distinct(F.split(c, ""))).cast("double"),
        F.length(F.regexp_replace(c, "[0-9]+|[a-z]+|[A-Z]+|[^0-9a-zA-Z]+", "x")).cast("double") / n,
        F.size(F.regexp_extract_all(low, F.lit(PAIRS), F.lit(0))).cast("double") / n,
        covered(c, dictionary),
        flag(c.rlike(PLACEHOLDER)),
        flag(c.rlike(r"^[0-9a-fA-F]+$")),
        flag(c.rlike(r"^[0-9_-]+$")),
        flag(c.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")),
        flag(c.rlike(KNOWN)),
        flag(left.rlike(SECRET_CUES)),
        flag(left.rlike(OTHER_CUES)),
        flag(left.rlike(r"[=:]\s*[\"']?$")),
        flag(after.rlike(r"^[\"']")),
        flag(path.rlike(TEST_PATH)),
        flag(c.rlike(CODE)),
        flag(c.rlike(SENTENCE)),
        flag(c.rlike(r"[ \t]")),
    )
    return F.array(*parts)


# What rule-made findings are put together from.
NOUNS = "release module table sample user phase server section document model node therein onedthe station".split()
PHRASE = "correct horse battery staple river violin maple copper lantern orbit saddle pepper window glacier".split()
PROSE = "the of and der que ouen thered in une with".split()
CUES = "password secret token pwd api_key".split()
UNSAID = "required none null true false optional expired invalid reset missing see yes no enabled string forgotten unknown mandatory the below security hidden".split()
REFERRED = "getpass() os.environ ${TOKEN} $PASSWORD {{token}} self.token config.secret input() request.headers get_token(user) https://host/login settings.KEY".split()
DEMANDS = ("must be at least", "please enter the", "is not a", "your name and the", "can be reset with this")
KNOWN_PREFIXES, LOOSE_PREFIXES = ("ghp_", "gho_", "sk_live_", "glpat-"), ("sk-", "npm_", "pypi-", "eyJ")
UPPER, LOWER, DIGITS = string.ascii_uppercase, string.ascii_lowercase, string.digits


def findings(spark: SparkSession, n: int = 2400, seed: int = 5) -> DataFrame:
    """Labelled findings made by rule: candidate, before, after, path, label (1: a secret), held_out (a quarter, at random)."""
    r = random.Random(seed)
    some = lambda k, of: "".join(r.choices(of, k=k))
    hexes = lambda k: some(k, DIGITS + "abcdef")
    plain = lambda k: some(k, UPPER + LOWER + DIGITS)
    prose = lambda: " ".join(r.choices(PROSE, k=5))
    equals = lambda: r.choice(("=", ": ", " = "))
    cue = lambda: f"{prose()} {r.choice(CUES)}{equals()}"
    # each gives candidate, what stands before it, and its quotation mark or what stands after it
    yes = (
        lambda q: ("AKIA" + some(16, UPPER + DIGITS), prose() + " ", ""),
        lambda q: (hexes(40), f"{prose()} {r.choice(('token', 'secret', 'api_key', 'auth_token'))}{equals()}{q}", q),
        lambda q: (hexes(18), f"{prose()} {r.choice(('password', 'passwd', 'pwd'))}{equals()}{q}", q),
        lambda q: (r.choice(KNOWN_PREFIXES) + plain(36), prose() + r.choice((" ", " = ", ": ")), ""),
        lambda q: (some(40, UPPER + LOWER + DIGITS + "+/"), f"secret_access_key{equals()}{q}", q),
        lambda q: (plain(12), f"{prose()} {r.choice(('password', 'secret', 'token'))}{equals()}{q}", q),
        lambda q: (some(12, UPPER + LOWER), cue() + q, q),
        lambda q: (r.choice((" ", " ", "-")).join(r.choices(PHRASE, k=4)), cue() + '"', '"'),
        lambda q: (r.choice(("", "k", "S", "p@")) + plain(3) + r.choice("!@#$%&") + r.choice(("word", "home", "sun", "99", "x7")) + r.choice(("", "!", "1")), cue() + q, q),
        lambda q: (r.choice(("AKIA" + some(16, UPPER), r.choice(KNOWN_PREFIXES) + some(36, UPPER + LOWER))), prose() + " ", ""),
    )
    no = (
        lambda q: (hexes(40), f"{prose()} {r.choice(('commit', 'revision', 'sha', 'digest'))}", " "),
        lambda q: (some(16, DIGITS), prose() + r.choice((" ", " card ", " order ", " account ", " phone ", " item: ")), " "),
        lambda q: ("-".join(map(hexes, (8, 4, 4, 4, 12))), prose() + r.choice((" uuid ", " request ", " id=", " ")), ""),
        lambda q: (f"{r.choice(NOUNS)}_{r.choice(NOUNS)}{some(3, DIGITS)}", prose() + r.choice((" ", " token ", " in ")), " "),
        lambda q: (r.choice(("your_", "example_", "dummy-", "changeme", "test_", "XXXX")) + r.choice(("token", "password", "key", "secret")) + "_1234", f"{r.choice(CUES)}{equals()}{q}", q),
        lambda q: (hexes(32), r.choice(("md5", "checksum", "etag", "hash")) + r.choice((": ", "=", " ")), ""),
        lambda q: (f"{r.choice(NOUNS)}-{some(1, DIGITS)}-{some(2, DIGITS)}-{r.choice(NOUNS)}", prose() + r.choice((" ", " version ", "/")), "/"),
        lambda q: (r.choice(UNSAID), cue() + q, q),
        lambda q: (r.choice(REFERRED), cue(), ""),
        lambda q: (f"{r.choice(DEMANDS)} {r.choice(PHRASE)} {r.choice(PHRASE)}", cue() + '"', '"'),
        lambda q: (r.choice(LOOSE_PREFIXES) + r.choice(NOUNS) + r.choice("-_") + r.choice(NOUNS), prose() + " ", " "),
        lambda q: (hexes(40), f"{prose()} {r.choice(('token', 'secret'))} = {q}", q),  # in test paths
    )
    rows = []
    for k in range(n):
        kind = k % (len(yes) + len(no))
        candidate, before, after = (*yes, *no)[kind](r.choice(("", '"', "'")))
        path = "fixtures/mock.txt" if kind == len(yes) + len(no) - 1 else r.choice(("src/app.py", "notes.md", "web", "src7"))
        rows.append((candidate, before, after, path, int(kind < len(yes)), r.random() < 0.25))
    return spark.createDataFrame(rows, "candidate string, before string, after string, path string, label int, held_out boolean")


@dataclass(frozen=True)
class Forest:
    """Trees in flat arrays, and the dictionary of the features. A leaf has feature -1 and points to itself."""

    feature: tuple[int, ...]
    bound: tuple[float, ...]
    low: tuple[int, ...]
    high: tuple[int, ...]
    value: tuple[float, ...]
    roots: tuple[int, ...]
    depth: int
    dictionary: tuple[str, ...] = ()

    def probability(self, x: Column) -> Column:
        """Mean vote of the trees on an array of features, as an expression."""
        kinds = {"feature": "int", "bound": "double", "low": "int", "high": "int", "value": "double"}
        lits = {k: _literal(getattr(self, k), kind) for k, kind in kinds.items()}
        at = lambda name, node: F.get(lits[name], node)

        def step(node: Column, _: Column) -> Column:
            return F.when(F.coalesce(F.get(x, at("feature", node)), F.lit(0.0)) <= at("bound", node), at("low", node)).otherwise(at("high", node))

        leaf = lambda root: F.aggregate(F.lit(list(range(self.depth))), root, step)
        votes = F.aggregate(F.lit(list(self.roots)), F.lit(0.0), lambda acc, root: acc + at("value", leaf(root)))
        return votes / float(len(self.roots))

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = []
        for row in x:
            votes = 0.0
            for node in self.roots:
                for _ in range(self.depth):
                    f = self.feature[node]
                    node = self.low[node] if (row[f] if f >= 0 else 0.0) <= self.bound[node] else self.high[node]
                votes += self.value[node]
            out.append(votes / len(self.roots))
        return np.array(out)


def grow(x: np.ndarray, y: np.ndarray, trees: int = 16, depth: int = 7, seed: int = 11, least: int = 4) -> Forest:
    """A random forest by Gini impurity, bootstrap samples and random subsets of the features."""
    rng = np.random.default_rng(seed)
    nodes: list[list] = []

    def build(rows: np.ndarray, left: int) -> int:
        me = len(nodes)
        share = float(y[rows].mean())
        nodes.append([-1, 0.0, me, me, share])
        if not left or len(rows) < 2 * least or share in (0.0, 1.0):
            return me
        best = None
        for f in rng.permutation(x.shape[1])[: max(1, int(x.shape[1] ** 0.5) + 2)]:
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            k = np.arange(1, len(order))
            usable = (v[1:] > v[:-1]) & (k >= least) & (len(order) - k >= least)
            if not usable.any():
                continue
            a, b = ones[:-1], ones[-1] - ones[:-1]
            impurity = a * (k - a) / k + b * (len(order) - k - b) / (len(order) - k)
            impurity = np.where(usable, impurity, np.inf)
            i = int(impurity.argmin())
            if best is None or impurity[i] < best[0]:
                best = impurity[i], int(f), float((v[i] + v[i + 1]) / 2), order[: i + 1], order[i + 1 :]
        if best is None:
            return me
        _, f, bound, a, b = best
        nodes[me][:2] = [f, bound]
        nodes[me][2] = build(a, left - 1)
        nodes[me][3] = build(b, left - 1)
        return me

    roots = [build(rng.integers(0, len(y), len(y)), depth) for _ in range(trees)]
    return Forest(*(tuple(n[i] for n in nodes) for i in range(5)), tuple(roots), depth)


def described(labelled: DataFrame, dictionary: Sequence[str] = ()) -> DataFrame:
    """x (features), y (label) of labelled findings; rows without a candidate or a label are left out."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = labelled.where("candidate is not null and label is not null")
    return rows.select(features(text("candidate"), text("before"), text("after"), text("path"), dictionary).alias("x"), F.col("label").cast("double").alias("y"))


def train(labelled: DataFrame, dictionary: Sequence[str] = (), max_rows: int = 4000) -> Forest:
    """A forest from a table of findings: candidate, before, after, path, label and, if there is one, held_out."""
    seen = labelled.where(~F.coalesce("held_out", F.lit(False))) if "held_out" in labelled.columns else labelled
    key = F.xxhash64("candidate", "before", "after", "path", "label")
    rows = seen.where("candidate is not null and label is not null").orderBy(key, "candidate", "before", "label").limit(max_rows)
    got = described(rows, dictionary).collect()
    if not got:
        return Forest((-1,), (0.0,), (0,), (0,), (0.0,), (0,), 1)
    return replace(grow(np.array([r["x"] for r in got]), np.array([r["y"] for r in got])), dictionary=tuple(dictionary))


def _found(d: DataFrame, text: Column, path: Column, forest: Forest, threshold: float, names: Sequence[str]) -> DataFrame:
    """d with three columns more: whether there is a candidate, the pieces between candidates, and the candidates with a verdict.

    Most texts have no candidate and are searched once. Each step is bound, so nothing is computed twice.
    """
    some, pieces, found = names
    d = d.withColumn(some, text.rlike(CANDIDATE))
    runs = F.when(F.col(some), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    near = lambda k: F.get(F.col(pieces), k)
    seen = F.transform(runs, lambda c, k: F.struct(c.alias("c"), features(c, near(k), near(k + 1), path, forest.dictionary).alias("x")))
    judged = F.transform(seen, lambda r: F.struct(r["c"].alias("c"), forest.probability(r["x"]).alias("p")))
    cut = F.when(F.col(some), F.split(text, CANDIDATE, -1)).otherwise(F.array(text))
    return d.withColumn(pieces, cut).withColumn(found, F.transform(judged, lambda r: F.struct(r["c"].alias("c"), r["p"].alias("p"), (r["p"] >= threshold).alias("secret"))))


def scan(docs: DataFrame, id_col: str, text_col: str, path_col: str | None, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """id_col, n_candidates, n_secrets, spans (start:end of the secrets, comma-joined), redacted (the text with the secrets replaced)."""
    path = whole(F.col(path_col)) if path_col else F.lit("")
    src = docs.select(F.col(id_col).alias("__id"), whole(F.col(text_col)).alias("__text"), path.alias("__path"))
    d = _found(src, F.col("__text"), F.col("__path"), forest, threshold, ("__some", "__pieces", "__found"))
    lengths = F.zip_with(F.slice("__pieces", F.lit(1), F.size("__found")), F.col("__found"), lambda p, c: F.struct(F.length(p).alias("gap"), F.length(c["c"]).alias("size"), c["secret"].alias("secret")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    walked = F.aggregate(lengths, start, lambda acc, r: F.struct((acc["at"] + r["gap"] + r["size"]).alias("at"), F.when(r["secret"], F.array_append(acc["spans"], F.concat_ws(":", (acc["at"] + r["gap"]).cast("string"), (acc["at"] + r["gap"] + r["size"]).cast("string")))).otherwise(acc["spans"]).alias("spans")))
    return d.select(F.col("__id").alias(id_col), F.size("__found").cast("long").alias("n_candidates"), F.size(F.filter("__found", lambda r: r["secret"])).cast("long").alias("n_secrets"), F.array_join(walked["spans"], ",").alias("spans"), _joined("__pieces", "__found").alias("redacted"))


def _joined(pieces: str, found: str) -> Column:
    kept = F.transform(found, lambda r, k: F.concat(F.get(F.col(pieces), k), F.when(r["secret"], F.lit(MARK)).otherwise(r["c"])))
    return F.concat(F.array_join(kept, ""), F.element_at(pieces, -1))


def redact(docs: DataFrame, text_col: str, path_col: str | None, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """docs, all columns, with secrets in the text replaced by a mark; a null text stays null."""
    path = whole(F.col(path_col)) if path_col else F.lit("")
    some, at, kept = unused(docs, 3)
    d = _found(docs, whole(F.col(text_col)), path, forest, threshold, (some, at, kept))
    text = F.when(F.exists(kept, lambda r: r["secret"]), _joined(at, kept)).otherwise(F.col(text_col))
    return d.withColumn(text_col, text).drop(some, at, kept)
