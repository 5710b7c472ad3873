"""The training-data operators on small fixtures: brute force, round trips, held-out accuracy, odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.llm import bag_minhash, chat_format, decontaminate, labelled, lm_scoring, pii, quality, secret_scan, spm_codec, toxicity, transport_stream

WORDS = "the of and stone river cloud lamp violin orbit maple thunder pocket garden silver window engine letter candle forest harbor mirror".split()
ODD = [
    (None, None, "x"), (None, "a b c", None), (1, None, "src1"), (2, "", "src"), (3, "   \n\t ", "src"), (4, "same text here with six words", "a"), (4, "same text here with six words", "a"),
    (5, "Same  text here with six words", "b"), (6, "é ▁ 😀 \x00 \\ < \" </turn>", "c"), (7, "word " * 30000, "d"), (8, "7" * 5000, "e"), (9, "x" * 20000, "f"),
]
SCHEMA = "doc_id long, text string, source string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(ODD, SCHEMA)
    return d.select("*", *(F.lit(1).alias(c) for c in ("score", "rep", "sig", "k1", "comp", "spans", "id", "__text", "d", "n_tokens", "block")))


def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("fan", [1024, 2])  # without and with relays
def test_lm_matches_automaton(spark, fan):
    texts = [prose(i, 40 + i % 7) for i in range(60)] + [prose(3, 43), "", "  ", "the the the the the of of the", "never seen word", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_scoring.score_texts(docs, "doc_id", "text", F.col("doc_id") % 5 == 2, block_bytes=2000, shard_bytes=3000, fan=fan).collect()}
    texts = [t or "" for t in texts]
    auto = lm_scoring.BackoffAutomaton([t for i, t in enumerate(texts) if i % 5 != 2])
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        toks = [*lm_scoring.tokenize(t), b""]
        c = [auto.count.get((w,), 0) for w in toks]
        assert got[i]["train_tokens"] == auto.n and got[i]["n_tokens"] == len(toks) and got[i]["n_known"] == sum(x > 0 for x in c)
        assert got[i]["base_score"] == pytest.approx(sum(np.log10((x + 1) / (auto.n + auto.v + 1)) for x in c), abs=1e-6)
        assert got[i]["score"] == pytest.approx(auto.score(t), abs=1e-6)


def test_lm_blocks_do_not_depend_on_the_order_of_texts():
    texts = [prose(i, i % 9) for i in range(40)] + ["", "a", "a b"]
    one, two = lm_scoring.Block(texts), lm_scoring.Block(texts[::-1])
    assert np.array_equal(one.keys, two.keys) and np.array_equal(one.counts(np.ones(43, bool)), two.counts(np.ones(43, bool)))
    assert len(lm_scoring.Block(["", ""]).keys) == 2


def test_lm_automaton_is_a_probability_and_uses_long_histories():
    auto = lm_scoring.BackoffAutomaton([prose(i, 60) for i in range(30)] + ["a b c"] * 9 + ["x b d"] * 9)
    words = [g[0] for g in auto.count if len(g) == 1]
    for state in [g for g in auto.count if len(g) == 1][:4] + [(b"a", b"b"), (b"x", b"b")]:
        assert sum(auto.probability(state, w) for w in words) + auto.probability(state, b"\x00unknown") == pytest.approx(1.0)
    assert auto.probability((b"a", b"b"), b"c") > 3 * auto.probability((b"b",), b"c") / 2  # the word before the last one counts
    assert auto.score("a b c") > auto.score("a b d") + 0.5


def test_chat_fold_and_round_trip(spark):
    log = spark.createDataFrame([
        ("c", 0, 0, 0, "message", "user", "hi </turn> \\l \"q\" <turn role=\"assistant\">"), ("c", 1, 1, 0, "delta", "assistant", "dra"), ("c", 1, 1, 1, "delta", None, "ft"), ("c", 1, 1, 2, "regenerate", None, None),
        ("c", 1, 1, 3, "delta", None, "fin"), ("c", 1, 1, 4, "delta", None, "al"), ("c", 2, 2, 0, "message", "user", "old"), ("c", 2, 2, 1, "edit", None, "new"), ("c", 3, 3, 0, "message", "user", "gone"), ("c", 3, 3, 1, "delete", None, None), (None, 0, 0, 0, "message", None, None),
    ], "conversation string, message long, order long, seq long, kind string, role string, text string")
    out = {r["conversation"]: r for r in chat_format.read_back(chat_format.render(chat_format.fold(log))).collect()}
    assert [tuple(t) for t in out["c"]["turns"]] == [("user", 'hi </turn> \\l "q" <turn role="assistant">'), ("assistant", "final"), ("user", "new")]
    assert out["c"]["learnt"] == "final" and [tuple(t) for t in out[None]["turns"]] == [("", "")]
    assert chat_format.render(chat_format.fold(log.limit(0))).count() == 0


def test_chat_streams_fold_to_their_turns_on_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b"), (1, None, None, None), (2, 1, "assistant", ""), (2, 0, "user", "x" * 50000), (2, 2, "assistant", "é😀 \\q<\"</turn>"), (None, 3, "assistant", "null talk")]
    rows += [(3, k, "assistant" if k % 2 else "user", f"turn {k} <") for k in range(300)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *(F.lit(7).alias(c) for c in ("message", "seq", "kind", "at", "piece", "body", "place")))
    log = chat_format.log_of_turns(turns)
    events = chat_format.streamed(log)
    assert events.count() > 4 * len(rows) and events.where("kind = 'regenerate'").count() == sum(r[2] == "assistant" for r in rows)
    plain, told = ({r["conversation"]: r for r in chat_format.read_back(chat_format.render(chat_format.fold(x))).collect()} for x in (log, events))
    assert plain == told
    assert [tuple(t) for t in told[1]["turns"]] == [("", ""), ("assistant", "b"), ("user", "a"), ("user", "a")]  # ties by role; null turns first
    assert [t["text"] for t in told[2]["turns"]] == ["x" * 50000, "", "é😀 \\q<\"</turn>"] and told[2]["learnt"] == "é😀 \\q<\"</turn>"
    assert told[None]["learnt"] == "null talk" and told[3]["learnt"] == "".join(f"turn {k} <" for k in range(1, 300, 2))


@pytest.fixture(scope="module")
def forest(spark):
    return secret_scan.train(secret_scan.findings(spark), secret_scan.vocabulary(model()))


def test_secrets_on_held_out_findings(spark, forest):
    labelled = secret_scan.findings(spark).where("held_out")
    rows = secret_scan.described(labelled, forest.dictionary).collect()
    got = forest.predict(np.array([r["x"] for r in rows]))
    assert 400 < len(rows) < 800 and np.mean([(p >= 0.5) == r["y"] for p, r in zip(got, rows)]) > 0.97
    other = secret_scan.findings(spark, 1200, seed=99)  # another draw of the rule
    rows = secret_scan.described(other, forest.dictionary).collect()
    assert np.mean([(p >= 0.5) == r["y"] for p, r in zip(forest.predict(np.array([r["x"] for r in rows])), rows)]) > 0.97
    assert secret_scan.train(labelled.where("label > 5")).predict(np.zeros((1, 30)))[0] == 0.0


def brute_covered(c: str, dictionary) -> float:
    low = c.lower()
    held = {run[a : a + n] for run in re.findall("[a-z]{4,}", low) for n in range(4, 11) for a in range(len(run) - n + 1)} & set(dictionary)
    for w in sorted(held, key=lambda w: (-len(w), w)):
        low = low.replace(w, "\x01" * len(w))
    return low.count("\x01") / max(1, len(c))


def brute_features(c: str, before: str, after: str, path: str, dictionary) -> list[float]:
    import regex

    n, left, S = max(1, len(c)), before[-40:], secret_scan
    has = lambda p, t: float(bool(regex.search(p, t)))
    return [
        n, sum(x in "0123456789" for x in c) / n, sum("A" <= x <= "Z" for x in c) / n, sum("a" <= x <= "z" for x in c) / n, sum(not (x.isascii() and x.isalnum()) for x in c) / n,
        len(set(c)), len(regex.findall("[0-9]+|[a-z]+|[A-Z]+|[^0-9a-zA-Z]+", c)) / n, len(regex.findall(S.PAIRS, c.lower())) / n, brute_covered(c, dictionary),
        has(S.PLACEHOLDER, c), has("^[0-9a-fA-F]+$", c), has("^[0-9_-]+$", c), has("(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$", c), has(S.KNOWN, c),
        has(S.SECRET_CUES, left), has(S.OTHER_CUES, left), has("[=:]\\s*[\"']?$", left), has("^[\"']", after), has(S.TEST_PATH, path), has(S.CODE, c), has(S.SENTENCE, c), has("[ \\t]", c),
    ]


def test_secret_spans_equal_brute_force(spark, forest):
    import regex

    r = random.Random(8)
    found = secret_scan.findings(spark, 300, seed=3).collect()
    texts = [" ".join(x for f in r.sample(found, r.randrange(5)) for x in (prose(r.randrange(99), 3), f["before"] + f["candidate"] + f["after"])) for _ in range(60)]
    got = {x["doc_id"]: x for x in secret_scan.scan(spark.createDataFrame([(i, t, "src/app.py") for i, t in enumerate(texts)], SCHEMA), "doc_id", "text", "source", forest).collect()}
    some = 0
    for i, t in enumerate(texts):
        spans = [m.span() for m in regex.finditer(secret_scan.CANDIDATE, t)]
        edges = [0, *(x for s in spans for x in s), len(t)]
        x = [brute_features(t[a:b], t[edges[2 * k] : a], t[b : edges[2 * k + 3]], "src/app.py", forest.dictionary) for k, (a, b) in enumerate(spans)]
        want = [s for s, p in zip(spans, forest.predict(np.array(x)) if x else []) if p >= 0.5]
        assert got[i]["n_candidates"] == len(spans) and got[i]["spans"] == ",".join(f"{a}:{b}" for a, b in want)
        out, at = "", 0
        for a, b in want:
            out, at = out + t[at:a] + secret_scan.MARK, b
        assert got[i]["redacted"] == out + t[at:]
        some += len(want)
    assert some > 30


def test_secrets_without_digits_and_with_punctuation(spark, forest):
    r = random.Random(3)
    some = lambda n, of="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz": "".join(r.choice(of) for _ in range(n))
    secrets = [
        *(("see password=", some(12), " here") for _ in range(12)), ("the pwd: \"", "correct horse battery staple", "\" ok"), ("and secret='", "p@ss!word", "' ok"), ("a token = ", "k7#x", ", then"),
        ("db_password = \"", "correct-horse-battery-staple", "\""), ("password: ", "S3cr3t!pass#word", ""),
        *(("key ", "AKIA" + some(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), " used") for _ in range(6)), *(("with ", "ghp_" + some(36), " in it") for _ in range(6)),
    ]
    plain = ["password: required", "the token = getpass()", "secret = config.secret", "author: Smithson", "password: none", "sk-module_server", "nothing at all"]
    docs = [(i, a + v + b, "src1") for i, (a, v, b) in enumerate(secrets)] + [(100 + i, t, "src1") for i, t in enumerate(plain)]
    got = {x["doc_id"]: x for x in secret_scan.scan(spark.createDataFrame(docs, SCHEMA), "doc_id", "text", "source", forest).collect()}
    missed = [i for i, (a, v, _) in enumerate(secrets) if got[i]["spans"] != f"{len(a)}:{len(a + v)}"]
    assert len(missed) <= 1 and [t for i, t in enumerate(plain) if got[100 + i]["n_secrets"]] == []


def test_redaction_keeps_columns_of_any_name(spark, forest):
    d = spark.createDataFrame([(1, "password=q8Zk3LmW01xT", "a", "b"), (2, None, "c", "d")], "doc_id long, text string, __pieces string, __0 string")
    out = secret_scan.redact(d, "text", None, forest)
    assert out.columns == d.columns and [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, f"password={secret_scan.MARK}", "a", "b"), (2, None, "c", "d")]


def test_pii_base_kinds_equal_the_patterns():
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(k, g):
        digits = re.sub(r"\D", "", g)
        if k == "ip":
            return all(int(p) <= 255 for p in g.split("."))
        if k == "card":
            return 13 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
        return k == "email" or 9 <= len(digits) <= 15

    r = random.Random(5)
    bits = ["1", "23", "4", ".", "@", "a", "b-", "+4", " ", "(", "255", "256", "%", "é", "4111 1111 1111 1111", "://", "a.b", "iban "]
    for _ in range(4000):
        s = "".join(r.choice(bits) for _ in range(r.randint(0, 25)))
        want = ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in kinds.items() for m in re.finditer(p, s) if ok(k, m.group()))
        assert pii.joined(pii.find(s), pii.BASE) == want


def shown(text: str, kind: str) -> list[str]:
    return [text[a:b] for a, b in pii.find(text)[kind]]


def test_pii_addresses_and_accounts():
    for text, want in {
        "at 221 Baker Street, ok": ["221 Baker Street"], "221b, Upper Old Long Winding Baker Street": ["221b, Upper Old Long Winding Baker Street"], "see 10 rue de la Paix now": ["10 rue de la Paix"],
        "Calle Mayor 5 and Hauptstraße 7a": ["Calle Mayor 5", "Hauptstraße 7a"], "Plaza de las Flores 12": ["Plaza de las Flores 12"], "12 " + "Very " * 90 + "Long Road": ["12 " + "Very " * 90 + "Long Road"],
        "1 Elm Street 2 Oak Street": ["1 Elm Street", "2 Oak Street"], "flag true 5 times": [], "the plane 747": [], "construe 12": [], "railroad 66": [], "road works 5": [], "streets 5": [], "the Street": [],
    }.items():
        assert shown(text, "address") == want, text
    for text, want in {
        "pay DE89 3704 0044 0532 0130 00 now": ["DE89 3704 0044 0532 0130 00"], "IBAN DE89370400440532013000.": ["DE89370400440532013000"], "DE89370400440532013001": [], "XDE89370400440532013000": [],
        "account no. 1234567 ok": ["1234567"], "account 12345": [], "konto: 12-34 56-78": ["12-34 56-78"], "https://x:" + "y" * 900 + "@host/": ["x:" + "y" * 900], "https://host/@x": [],
    }.items():
        assert shown(text, "account") == want, text


def test_pii_address_and_account_equal_brute_force():
    r = random.Random(6)
    bits = ["12", "5b", "Baker", "Old", "street", "Street", "road", "Calle", "calle", "rue", "de", "la", "straße", "Haupt", ",", " ", " ", " ", "x", "account", "no.", "://", "@", "a.b", "1234567", "\n"]
    word, small = r"[A-ZÄÖÜ][\w'.-]*", "(?: (?:de|la|las|los|del|des|du|le))*"
    number = r"(?<![^\s])[0-9]+[a-z]?,? "
    first = rf"{number}(?:{word} )*(?i:street|avenue|road|boulevard|lane)(?![^\W\d_])"
    last = rf"(?<![^\W\d_])(?i:calle|avenida|plaza)(?![^\W\d_])(?:{small} {word})*,? [0-9]+[a-z]?(?![0-9A-Za-z])"
    for _ in range(3000):
        s = "".join(r.choice(bits) for _ in range(r.randint(0, 18)))
        got = pii.find(s)
        for a, b in got["address"]:  # nothing but what the grammar allows, and no overlap
            assert re.fullmatch(rf"{first}|{last}|[^\W\d_]*(?i:straße|strasse)(?:{small} {word})*,? [0-9]+[a-z]?|(?i:rue|avenue|boulevard)(?:{small} {word})*,? [0-9]+[a-z]?|{number}(?:{word} )*(?i:rue|avenue|boulevard)(?:{small} {word})*", s[a:b]), (s, s[a:b])
        assert all(x[1] <= y[0] for x, y in zip(got["address"], got["address"][1:]))
        for m in re.finditer(rf"{first}", s):  # and nothing missed that stands alone
            assert any(a < m.end() and b > m.start() for a, b in got["address"]), (s, m.group())
        userinfo = [m.span(1) for m in re.finditer(r"://([A-Za-z0-9._~%!$&'()*+,;=:-]+)(?=@[A-Za-z0-9.-])", s)]
        assert set(userinfo) <= set(got["account"]), s


def near_fixture() -> list[tuple[int, str]]:
    r, out = random.Random(9), []
    for fam in range(25):
        base = prose(fam, 120).split()
        for copy in range(1 + fam % 6):
            words = list(base)
            for _ in range(r.randrange(0, 9)):
                words[r.randrange(len(words))] = "edit" + str(r.randrange(10**6))
            out.append((len(out) + 10, " ".join(words)))
    out += [(i, out[i % 7][1].upper() if i % 2 else out[i % 7][1]) for i in range(5)]
    base = prose(77, 150).split()
    for k in range(40):  # a chain of edits: neighbours are alike, ends are not
        base[(k * 3) % 150] = f"chain{k}"
        out.append((1000 + k, " ".join(base)))
    return out


def alike(a: Counter, b: Counter) -> float:
    total = sum((a | b).values())
    return sum((a & b).values()) / total if total else 1.0


def bag(text: str) -> Counter:
    w = text.lower().split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows, at=0.8):
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if alike(bags[i], bags[j]) >= at:
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return {i: least[root(k)] for k, (i, _) in enumerate(rows)}


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bag_minhash, "CHUNK", 4)
    rows = near_fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = bag_minhash.classes(docs, "doc_id", "text").collect()
    got, want = {r["doc_id"]: r["class_id"] for r in out}, brute_classes(rows)
    assert got == want
    texts = {c: len({" ".join(t.lower().split()) for i, t in rows if want[i] == c}) for c in want.values()}
    assert {r["doc_id"]: r["n_texts"] for r in out} == {i: texts[c] for i, c in want.items()}
    kept = sorted(r["doc_id"] for r in bag_minhash.keep_first(docs, "doc_id", "text").collect())
    assert kept == sorted(set(want.values()))


def test_near_duplicates_of_a_large_family_below_the_threshold(spark):
    """600 texts around one base, pairs on both sides of 0.8: classes equal brute force over all pairs."""
    r, base = random.Random(12), prose(5, 100).split()
    rows = []
    for k in range(600):
        words = list(base)
        for _ in range(r.choice((1, 1, 2, 3))):
            words[r.randrange(100)] = f"edit{r.randrange(10**9)}"
        rows.append((k, " ".join(words)))
    got = {x["doc_id"]: x["class_id"] for x in bag_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == brute_classes(rows)


def test_keep_first_keeps_columns_of_any_name(spark):
    d = spark.createDataFrame([(1, "a b c d e f", "x", "y"), (2, "A b c d e f", "z", "w"), (None, "other text", "n", "m")], "doc_id long, text string, __k1 string, __0 string")
    out = bag_minhash.keep_first(d, "doc_id", "text")
    assert out.columns == d.columns and sorted(map(tuple, out.collect()), key=str) == [(1, "a b c d e f", "x", "y"), (None, "other text", "n", "m")]


def test_signatures_are_unbiased():
    r, errors = random.Random(2), []
    for k in range(60):
        a, b = [[r.randrange(12) for _ in range(60)] for _ in range(2)]
        bags = [(lambda u: (bag_minhash.mix64(u[0].astype(np.uint64) + np.uint64(1000 * k)), u[1]))(np.unique(x, return_counts=True)) for x in (a, b)]
        bags = [(h[np.argsort(h)], w[np.argsort(h)]) for h, w in bags]
        s = bag_minhash.signatures(bags)
        errors.append((s[0] == s[1]).mean() - bag_minhash.overlap(*bags))
    assert abs(np.mean(errors)) < 0.03


def test_classifiers_on_held_out_texts():
    r = random.Random(4)
    toxic = [(prose(i, 60) + (f" you {r.choice(['grumblehead', 'snotface', 'dunderling'])}" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(300)]
    w, b = toxicity.fit(toxic[:200])
    assert np.mean([(toxicity.score(t, w, b) >= 0.3) == y for t, y in toxic[200:]]) > 0.95
    good = [(prose(i, 80) if i % 2 else "".join(r.choice("$%&*#") * 3 + w_.upper() + " " for w_ in prose(i, 60).split()), i % 2) for i in range(200)]
    c = quality.fit(good[:120])
    assert np.mean([(c.score(t) >= 0.7) == y for t, y in good[120:]]) > 0.95
    assert 0 <= quality.fit([]).score("x") <= 1 and toxicity.fit([("a", 1)])[0].max() == 0


def test_codec_equals_library():
    import sentencepiece

    ours, theirs = spm_codec.PrefixTableCodec(model()), sentencepiece.SentencePieceProcessor(model_file=model())
    r = random.Random(1)
    bits = ["a", "b", " ", "  ", "\n", "\x00", "é", "▁", "😀", "0", "the", "ing", "aaaa", "中", "=====", "<s>", "�", "\r", "ß", "<0x0A>"]
    for _ in range(4000):
        s = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert ours.encode(s) == theirs.encode(s) and ours.decode(ours.encode(s)) == theirs.decode(theirs.encode(s))


def test_decontamination_finds_changed_questions(spark):
    item = "a farmer called Anna has 12 apples and 12 pears and sells 5 apples to her friend Boris for 3 dollars each day"
    docs = spark.createDataFrame([
        (None, "intro. " + item + " more"), (1, "intro words here. " + item + " and then more"), (2, "intro. " + item.replace("12", "40").replace("Anna", "Clara").replace("5", "7")),
        (3, "intro. " + item.replace("12 apples", "40 apples").replace("12 pears", "90 pears")), (4, prose(1, 50)), (5, None), (None, item), (6, ""),
    ], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, "too short"), (9, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.match(docs, items, "doc_id", "text", "item_id", "text").collect()}
    assert got[1, 7]["coverage"] == 1.0 and got[1, 7]["changed"] == 0 and got[2, 7]["coverage"] == 1.0 and got[2, 7]["changed"] >= 3
    assert (3, 7) not in got or got[3, 7]["coverage"] < 1.0
    assert {d for d, _ in got} <= {1, 2, 3, None} and (None, 7) in got
    kept = {r["doc_id"] for r in decontaminate.keep_clean(docs, items, "doc_id", "text", "item_id", "text").collect()}
    assert kept >= {4, 5, 6} and not kept & {1, 2, None}


def test_decontamination_of_repeated_ids_short_items_and_odd_columns(spark):
    a, b = prose(41, 30), prose(42, 30)
    items = spark.createDataFrame([(7, a), (7, b), (None, prose(43, 25)), (8, "Paris, 12 km"), (9, "one word pair here"), (10, ""), (11, "zyzzyva"), (12, "!?")], "item_id long, text string")
    rows = [(1, f"x {a} y"), (1, f"x {b} y"), (2, prose(43, 25)), (None, a), (None, "clean text"), (3, "He saw paris 12 KM away"), (4, "Paris, 14 km"), (5, "so one word pair here it is"), (6, "the Zyzzyva!"), (6, "zyzzyvas"), (1, f"x {a} y"), (7, None), (8, ""), (9, "Paris 12 km"), (10, "zyzzyva"), (11, "one two three four zyzzyva six"), (12, "a b c d e f in Paris, 12 km of g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("k").alias(c) for c in ("d", "i", "h", "id", "item", "__0", "__1", "w", "shift")))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.match(docs, items, "doc_id", "text", "item_id", "text").collect()}
    assert got == {(1, 7), (2, None), (None, 7), (3, 8), (5, 9), (6, 11), (9, 8), (10, 11), (11, 11), (12, 8)}
    kept = decontaminate.keep_clean(docs, items, "doc_id", "text", "item_id", "text")
    assert kept.columns == docs.columns and sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(None, "clean text"), (4, "Paris, 14 km"), (6, "zyzzyvas"), (7, None), (8, "")], key=str)


def test_template_tokens():
    import regex

    tokens = lambda t: [m.group() for m in regex.finditer(decontaminate.TOKEN, ". " + t)]
    assert tokens("Anna met Boris Smith. Then 5kg, 3, 4 of it")[1:] == ["met", "Boris Smith", ". Then", "5kg", "3, 4", "of", "it"] and tokens("15 kilo")[1:] == ["15", "kilo"]


def test_decontamination_equals_brute_force_on_exact_windows(spark):
    """Without placeholders coverage is the share of an item's windows that lie on one line in a text, or on lines near to each other."""
    r = random.Random(4)
    words = [f"{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    items = [(k, " ".join(r.choices(words, k=r.choice((4, 6, 8, 15, 24))))) for k in range(12)]
    docs = []
    for k in range(80):
        parts = []
        for _ in range(r.randrange(3)):
            w = r.choice(items)[1].split()
            a = r.randrange(0, max(1, len(w) // 2))
            parts += r.choices(words, k=r.randrange(5)) + w[a : a + r.randrange(1, len(w) + 1)]
        docs.append((k, " ".join(parts)))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x for x in decontaminate.match(*frames, "doc_id", "text", "item_id", "text").collect()}
    want = {}
    for d, text in docs:
        for i, item in items:
            t, q = text.split(), item.split()
            n = 8 if len(q) >= 8 else 4
            lines = {}
            for x in range(len(q) - n + 1):
                for y in range(len(t) - n + 1):
                    if q[x : x + n] == t[y : y + n]:
                        lines.setdefault(y - x, set()).add(x)
            groups = []
            for shift in sorted(lines):
                if groups and shift - groups[-1][-1] < max(4, len(q) / 2):
                    groups[-1].append(shift)
                else:
                    groups.append([shift])
            best = max((len(set().union(*(lines[s] for s in g))) for g in groups), default=0)
            if 2 * best >= len(q) - n + 1:
                want[d, i] = best
    assert {k: r["windows"] for k, r in got.items()} == want and len(want) > 10


def test_rows_of_numbers_are_one_placeholder(spark):
    table = " ".join(str(k * 7) for k in range(4000)) + " Word" * 4000
    docs = spark.createDataFrame([(1, table), (2, "sum of " + table)], "doc_id long, text string")
    item = spark.createDataFrame([(1, "the total of 3 4 5 6 7 8 9 10 11 12 13 and 4 5 6 and the rest of 9 8 7 is what")], "item_id long, text string")
    assert decontaminate.match(docs, item, "doc_id", "text", "item_id", "text").count() == 0


def test_decontamination_finds_values_of_other_lengths(spark):
    unit = "a parcel that holds 5kg of river sand is carried over the hill by two tired men who want a better road"
    town = "the slow train to York leaves with 60 sleepy people while a second one comes back from York with 60 of them on board"
    name = "one fine day in the garden old Anna saw how a cat ran up the wall and fell from it into a deep blue pond with some fish"
    twice = "he gave 12 coins to one child and 12 coins to another child and then he put 12 coins back"
    items = [(1, unit), (2, town), (3, name), (4, twice)]
    docs = [
        (1, unit.replace("5kg", "15kg")), (2, town.replace("York", "New York").replace("60", "80")), (3, "so. " + name.replace("Anna", "Ludwig van Beethoven") + " and more"),
        (4, twice.replace("12", "7", 1).replace("12", "95", 1)), (5, name[:70] + " " + prose(1, 60) + " " + unit[:60]), (6, unit + ". " + prose(2, 90) + ". " + unit.replace("5kg", "15kg")),
    ]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.match(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), "doc_id", "text", "item_id", "text").collect()}
    assert {(1, 1), (2, 2), (3, 3), (6, 1)} <= set(got) <= {(1, 1), (2, 2), (3, 3), (6, 1), (4, 4)}
    assert got[1, 1]["coverage"] == got[2, 2]["coverage"] == got[6, 1]["coverage"] == 1.0 and got[1, 1]["changed"] == 1 and got[2, 2]["changed"] == 4 and got[6, 1]["changed"] == 0
    n = len(name.split()) - 7  # only the windows over the longer name are lost
    assert got[3, 3]["windows"] == n - 7 and got[3, 3]["coverage"] == pytest.approx((n - 7) / n)


def test_transport_stream():
    for n in (0, 1, 168, 181, 182, 183, 192, 4032, 4033, 40000):
        p = bytes(i % 251 for i in range(n))
        s = transport_stream.demux(transport_stream.mux(p))
        assert s.samples == p and not s.errors and not s.discontinuities and len(s.stamps) == -(-n // transport_stream.UNIT)
    m = transport_stream.mux(bytes(9000))
    lost = transport_stream.demux(m[: 188 * 10] + m[188 * 11 :])
    assert lost.discontinuities == 1 and lost.errors >= 1
    assert transport_stream.demux(m[: 188 * 8] + m[188 * 7 :]).samples == bytes(9000)  # one packet sent twice
    assert transport_stream.demux(b"junk").errors and transport_stream.demux(m[:100]).errors


def test_transport_stream_finds_its_sync_again():
    """A byte lost, added or changed costs the packet it is in, and those of its unit, but not the rest."""
    unit = transport_stream.UNIT
    p = bytes(i % 251 for i in range(10 * unit))
    m = transport_stream.mux(p)
    for at in (188 * 60 + 90, 188 * 60 + 1, 188 * 3):
        for broken in (m[:at] + m[at + 1 :], m[:at] + b"G" + m[at:], m[: at - 188] + m[at - 100 :], b"xx" + m):
            s = transport_stream.demux(broken)
            assert s.errors and len(s.samples) >= len(p) - unit - 2 * 188 and len(s.stamps) >= 9 and s.stamps == sorted(s.stamps)
    flipped = bytearray(m)
    flipped[188 * 60] = 0
    s = transport_stream.demux(bytes(flipped))
    assert s.errors and s.discontinuities == 1 and len(s.samples) == len(p) - 184


def test_transport_stream_columns(spark):
    texts = [(1, "x" * 9000), (2, None), (None, ""), (2, "é" * 200)]
    d = transport_stream.encode_column(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text").withColumn("stamps", F.lit("clash")).withColumn("extra", F.lit(1))
    rows = transport_stream.probe_column(d, "media").collect()
    assert [r["doc_id"] for r in rows] == [1, 2, None, 2] and rows[0]["extra"] == 1
    for (_, t), r in zip(texts, rows):
        payload, n = transport_stream.payload_of(t or "")
        assert r["n_bytes"] == n and r["samples"] == payload and r["media"] == transport_stream.mux(payload) and r["errors"] == 0
        assert r["stamps"] == [k * transport_stream.UNIT * 90000 // 8000 for k in range(-(-len(payload) // transport_stream.UNIT))]
        assert [x["stamp"] for x in r["random_access"]] == r["stamps"][:: transport_stream.RAP_EVERY] and r["programs"] == r["streams"] == 1
    out = {(r["doc_id"], r["n_bytes"]): r for r in transport_stream.store_and_read(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text").collect()}
    for i, t in texts:
        payload, n = transport_stream.payload_of(t or "")
        r, media = out[i, n], transport_stream.mux(payload)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])) and (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())


def test_sample_is_bounded_and_the_same(spark):
    docs = spark.createDataFrame([(k % 7, f"text {k}") for k in range(500)] + [(None, "n"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(7)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = labelled.sample(docs, labels, "doc_id", "text", "toxic", lambda c: c != 2, 40)
    assert len(got) == 40 and got == labelled.sample(docs.repartition(5), labels, "doc_id", "text", "toxic", lambda c: c != 2, 40)
    assert len(labelled.sample(docs, labels, "doc_id", "text", "toxic", lambda c: c != 2, 4000)) == sum(k % 7 != 2 for k in range(500)) + 1


def test_dictionaries_use_all_texts():
    texts = [prose(k, 90).encode() for k in range(300)]
    d = quality.content(texts, 1 << 20)
    assert all(t in d for t in texts) and len(quality.content(texts, 20_000)) <= 20_000
    late = [prose(k, 40).encode() + b" the late phrase that recurs " * 3 for k in range(300)]  # beyond any prefix
    assert b"late phrase" in quality.content(late, 6000)
    assert len(quality.content([b"same"] * 9, 20)) <= 20 and quality.content([], 10) == b""


def test_odd_rows(spark, odd):
    n = odd.count()
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, prose(5, 20))], "item_id long, text string")
    any_id = lambda c: F.lit(True)
    fitted = toxicity.fit(labelled.sample(odd, labels, "doc_id", "text", "toxic", any_id, 8000))
    forest = secret_scan.train(secret_scan.findings(spark, 400))
    same = {
        "lm": lambda d: lm_scoring.score_texts(d, "doc_id", "text", F.col("doc_id") == 2),
        "pii": lambda d: pii.scan(d, "doc_id", "text"),
        "near": lambda d: bag_minhash.classes(d, "doc_id", "text"),
        "toxic": lambda d: toxicity.score_texts(d, labels, "doc_id", "text", "toxic", any_id),
        "spm": lambda d: spm_codec.digests(d, "doc_id", "text", model()),
        "spm full": lambda d: spm_codec.encode_decode(d, "doc_id", "text", model()),
        "quality": lambda d: quality.score_texts(d, labels, "doc_id", "text", "quality", any_id),
        "ts": lambda d: transport_stream.store_and_read(d, "doc_id", "text"),
        "ts columns": lambda d: transport_stream.probe_column(transport_stream.encode_column(d, "doc_id", "text"), "media"),
        "secrets": lambda d: secret_scan.scan(d, "doc_id", "text", "source", forest),
        "redact": lambda d: secret_scan.redact(d, "text", None, forest),
    }
    got = {}
    for name, f in same.items():
        got[name] = f(odd).collect()
        assert len(got[name]) == n, name
        assert f(odd.limit(0)).collect() == [], name
    texts = [t or "" for _, t, _ in ODD]
    # equal texts have equal values; null and empty texts are one; each value is what the text alone gives
    assert {r["n_tokens"] for r in got["lm"] if r["doc_id"] == 7} == {30001} and {r["n_tokens"] for r in got["lm"] if r["doc_id"] in (2, 3)} == {1}
    assert sorted(r["spans"] for r in got["pii"]) == sorted(pii.joined(pii.find(t), pii.KINDS) for t in texts)
    assert sorted(r["score"] for r in got["toxic"]) == pytest.approx(sorted(toxicity.score(t, *fitted) for t in texts))
    assert len({r["score"] for r in got["quality"] if r["doc_id"] == 4}) == 1 and all(0 <= r["score"] <= 1 for r in got["quality"] + got["toxic"])
    assert sorted(r["n_bytes"] for r in got["ts"]) == sorted(len(t.encode()) for t in texts)
    assert sorted(r["payload_sha256"] for r in got["ts"]) == sorted(hashlib.sha256(transport_stream.payload_of(t)[0]).hexdigest() for t in texts)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model())
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got["spm"]) == sorted((len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(sp.decode(i).encode()).hexdigest()) for i in map(sp.encode, texts))
    assert sorted(r["redacted"] for r in got["secrets"]) == sorted(texts) and sorted(str(r["text"]) for r in got["redact"]) == sorted(str(t) for _, t, _ in ODD)
    classes = {r["doc_id"]: r["class_id"] for r in got["near"]}
    assert classes[4] == classes[5] == 4 and classes[1] == classes[2] == classes[3] == 1 and classes[7] == 7
    assert {r["class_id"] for r in got["near"] if r["doc_id"] is None} == {1, None}  # rows of one id, each by its text
    assert decontaminate.match(odd, items, "doc_id", "text", "item_id", "text").count() == 0
    assert decontaminate.match(odd, items.limit(0), "doc_id", "text", "item_id", "text").count() == 0
    assert decontaminate.keep_clean(odd, items, "doc_id", "text", "item_id", "text").count() == n
    kept = bag_minhash.keep_first(odd, "doc_id", "text")
    assert kept.columns == odd.columns
    got = sorted(((r["doc_id"], (r["text"] or "")[:9]) for r in kept.collect()), key=str)
    assert len(got) == n - 5  # of the empty texts one stays, and of the same texts one
    assert toxicity.keep_clean(odd, labels.limit(0), "doc_id", "text", "toxic", any_id).columns == odd.columns


def test_pipeline_equals_stages_by_hand(spark):
    import corpus_pipeline
    import sentencepiece

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_texts(docs, labels, "doc_id", "text", "toxic", lambda c: F.crc32(c.cast("string")) % 4 != 2).collect()}
    left = {i: t for i, t in rows.items() if scores[i] < 0.3}
    classes = brute_classes(sorted(left.items()))
    left = {i: t for i, t in left.items() if classes[i] == i}
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not any(x in t for x in items)}
    secret = re.compile(r'AKIA[A-Z0-9]{16}|(?<=token = ")[0-9a-f]{40}|(?<=password=)[0-9a-f]{18}')
    left = {i: secret.sub(secret_scan.MARK, t) for i, t in left.items()}
    sp = sentencepiece.SentencePieceProcessor(model_file=model())
    want = {i: hashlib.sha256(",".join(map(str, sp.encode(t))).encode()).hexdigest() for i, t in left.items()}
    got = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [*((i, t, s, "en", len(t or "")) for i, t, s in ODD), (None, f"so {item} it was", "x", "en", 3), (None, "password=q8Zk3LmW01xT ok", None, "en", 3), (30, "7 " * 3000, "x", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").select("*", *(F.lit(5).alias(c) for c in ("__0", "__1", "id", "rep", "score", "__pieces")))
    for stage in (docs, docs.limit(0)):
        d = stage
        for name, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, d, sf)
            assert out.columns == docs.columns, name
            d = spark.createDataFrame(out.collect(), docs.schema)
            if name == "toxicity":
                assert d.count() == stage.count()
        last = corpus_pipeline.STAGES[-1][1](spark, d, sf)
        assert last.count() == d.count()
        if stage is docs:
            left = [(r["doc_id"], r["text"], r["n_chars"]) for r in d.collect()]
            assert (None, f"password={secret_scan.MARK} ok", 9 + len(secret_scan.MARK) + 3) in left and not any(item in (t or "") for _, t, _ in left)
            assert sum(t == "same text here with six words" for _, t, _ in left) == 1 and len(left) == len(rows) - 1 - 5
