import datetime as dt
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspan.llm import chat, decontaminate, lm, pii, quality
from tests.llm.fixtures import no_documents, odd_documents, words


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


# language model


@pytest.mark.parametrize("head", [3, 100_000])
def test_base_score_is_exact(spark, head, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", head)
    df = odd_documents(spark, clashing=True)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(w for d, t in rows if not held(d) for w in [*plain_words(t), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for d, t in rows:
        tokens = [*plain_words(t), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        want.append((d, held(d), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 6)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.score(df, lm.in_training("doc_id")).collect()]
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=order) == sorted(want, key=order)


def test_filter_gives_levels_back(spark):
    rng = np.random.default_rng(2)
    h = rng.integers(-(1 << 62), 1 << 62, 3000)
    c = (2 ** rng.integers(0, 12, 3000)).astype(np.int64)
    held = lm.build_filter(spark.createDataFrame([(int(a), int(b)) for a, b in zip(h, c, strict=True)], "h long, c long"), 1 << 20)
    got = held.levels(h.view(np.uint64))
    assert (got >= np.log2(c) + 1).all()  # never too low
    assert (got == np.log2(c) + 1).mean() > 0.97
    other = rng.integers(-(1 << 62), 1 << 62, 20_000).view(np.uint64)
    assert (held.levels(other) > 0).mean() < 0.03


def test_model_beats_base_on_held_out_text(spark):
    rng = random.Random(3)
    rows = []
    for d in range(400):
        w = [rng.randrange(50)]
        for _ in range(60):
            w.append((w[-1] * 7 + rng.choice([0, 0, 0, 1])) % 50)
        rows.append((d, " ".join(f"w{x}" for x in w)))
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), lm.in_training("doc_id")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.6 * got[1]


def test_filter_beyond_one_broadcast_scores_the_same(spark, monkeypatch):
    df = odd_documents(spark).union(odd_documents(spark))
    monkeypatch.setattr(lm, "BITS_PER_ITEM", 20_000)  # many segments
    monkeypatch.setattr(lm, "BLOCK", 2)
    monkeypatch.setattr(lm, "ASKED_BYTES", 20_000)
    rows = lambda **kw: sorted(((r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.score(df, lm.in_training("doc_id"), **kw).collect()))
    grams = spark.createDataFrame([(i, 1) for i in range(5000)], "h long, c long")
    held = lm.build_filter(grams, 1)
    assert held.bits is None and held.filled.count() == held.segments > 2 * lm.BLOCK
    assert rows(max_bytes=1) == rows(max_bytes=1 << 30)


def test_scores_do_not_follow_what_is_sent_or_how_it_is_asked(spark, monkeypatch):
    df = odd_documents(spark).union(odd_documents(spark))
    rows = lambda: sorted((r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in lm.score(df, lm.in_training("doc_id")).collect())
    monkeypatch.setattr(lm, "BITS_PER_ITEM", 20_000)  # many segments
    want = rows()
    for name, value in {"HEAD": 3, "BLOCK": 1, "ROUNDS": 3, "CHUNK_BYTES": 2000, "CUT_BYTES": 700, "ASKED_BYTES": 500, "PART": 300}.items():
        monkeypatch.setattr(lm, name, value, raising=False)
    assert rows() == want


def test_a_chunk_asks_for_its_distinct_pairs(spark):
    bus, seen = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()

    def written():
        bus.waitUntilEmpty()
        return sum(seen.executorList(False).apply(i).totalShuffleWrite() for i in range(seen.executorList(False).size()))

    rng = random.Random(5)
    passage = " ".join(f"{rng.randrange(9000)}x" for _ in range(20_000))
    df = spark.createDataFrame([(i, passage) for i in range(24)], "doc_id long, text string").coalesce(1)
    before = written()
    got = lm.score(df, lm.in_training("doc_id"), max_bytes=1).collect()
    assert len(got) == 24 and len({round(r.score, 6) for r in got}) == 1
    assert written() - before < 7 * 24 * 20_000  # fewer bytes than one hash a position


def test_pairs_that_occur_once_count(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c d"), (11, "a b"), (12, "a d")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(df, F.col("doc_id") < 10).collect()}
    assert got[11] > got[12] + 0.01


@pytest.mark.parametrize("head, max_bytes, near", [(100_000, 1 << 30, 1e-6), (5, 1 << 30, 0.0045), (5, 1, 0.0045)])
def test_score_is_the_models_and_sums_to_one(spark, head, max_bytes, near, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", head)
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(vocabulary[min(int(rng.expovariate(0.12)), 38)] for _ in range(rng.randrange(30)))) for i in range(150)]
    learn = [[*t.split(), None] for _, t in docs]
    uni = Counter(w for t in learn for w in t)
    two = Counter(p for t in learn for p in zip(["begin", *t], t, strict=False))
    e = lambda n: 2 ** (n.bit_length() - 1) if n else 0
    mu, flat = 32.0, sum(map(e, uni.values())) + len(uni) + 1
    total = Counter()
    for (v, _), n in two.items():
        total[v] += e(n)
    p = lambda v, w: (e(two[v, w]) + mu * (e(uni[w]) + 1) / flat) / (total[v] + mu)
    for v in ["begin", "never", *uni]:
        assert abs(sum(p(v, w) for w in uni) + p(v, "never") - 1) < 1e-9
    asked = [(1000 + i, t) for i, t in enumerate([*(f"{v} {w}" for v in vocabulary for w in vocabulary), "", "never", "W1 never w2"])]
    got = lm.score(spark.createDataFrame(docs + asked, "doc_id long, text string"), F.col("doc_id") < 1000, mu=mu, max_bytes=max_bytes).filter("held_out")
    scores = {r.doc_id: (r.score, r.n_tokens) for r in got.collect()}
    assert len(scores) == len(asked)
    off = []
    for i, t in asked:
        tokens = [*t.lower().split(), None]
        want = sum(math.log10(p(v, w)) for v, w in zip(["begin", *tokens], tokens, strict=False))
        off.append(abs(scores[i][0] - want) / scores[i][1])
    # a pair that the filter makes up is rare, and adds little
    assert np.mean(np.array(off) > near) < 0.002, max(off)


def test_contexts_that_share_half_a_hash(spark, monkeypatch):
    lower = np.uint64(0xFFFF_FFFF)
    sequences = lm.sequences

    def one_half(texts):  # all words but the frequent one have its upper half
        w, v, n = sequences(texts)
        same = lambda h: np.where((h == lm.END) | (h == lm.BEGIN), h, np.uint64(7 << 32) | h & lower)
        return same(w), same(v), n

    monkeypatch.setattr(lm, "sequences", one_half)
    monkeypatch.setattr(lm, "HEAD", 1)
    docs = [(i, "often here") for i in range(63)] + [(100, "rare"), (101, "rarer")]
    got = lm.score(spark.createDataFrame(docs, "doc_id long, text string"), F.lit(True)).collect()
    assert len(got) == 65 and all(r.score is not None and math.isfinite(r.score) and r.score < 0 for r in got)


def test_score_of_nothing(spark):
    assert lm.score(no_documents(spark), lm.in_training("doc_id")).collect() == []
    only = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = lm.score(only, F.lit(False)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)


# quality


def test_classifier_tells_junk_from_prose(spark):
    rng = random.Random(8)
    prose = lambda: " ".join(" ".join(words(rng, 8, 999)).replace("x", "ab").translate(str.maketrans("0123456789", "acegikmoqs")).capitalize() + "." for _ in range(8))
    junk = [
        lambda: " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in prose().split()),
        lambda: " ".join(w.upper() + "!!" for w in prose().split()),
        lambda: " ".join([rng.choice(prose().split())] * 70),
        lambda: " | ".join(prose().split()),
        lambda: "\n".join([prose()[:60]] * 12),
    ]
    rows = [(i, prose() if i % 6 else junk[i // 6 % 5]()) for i in range(900)]
    got = quality.classify(spark.createDataFrame(rows, "doc_id long, text string"), sample=600).collect()
    wrong_good = sum(not r.keep for r in got if r.doc_id % 6)
    wrong_bad = sum(r.keep for r in got if r.doc_id % 6 == 0)
    assert wrong_good <= 5 and wrong_bad <= 8, (wrong_good, wrong_bad)


def test_classifier_on_odd_rows(spark):
    df = odd_documents(spark, clashing=True)
    got = quality.classify(df)
    assert got.columns == [*(c for c in df.columns if c != "quality"), "quality", "keep"]
    assert got.count() == df.count() and got.filter("quality is null or keep is null").count() == 0
    kept = quality.drop_rejected(df, threshold=0.0)
    assert kept.columns == df.columns and {r.quality for r in kept.collect()} == {"7"}
    dotted = df.withColumn("keep", F.lit("mine")).withColumn("a.b", F.lit(1))
    kept = quality.drop_rejected(dotted, threshold=0.0)
    assert kept.columns == dotted.columns and {r.keep for r in kept.collect()} == {"mine"}
    assert quality.classify(no_documents(spark)).collect() == []


def test_em_finds_accuracies():
    rng = np.random.default_rng(0)
    counts = Counter()
    k = len(quality.LABELLERS)
    truth = rng.random(20_000) < 0.8
    hit = np.linspace(0.3, 0.8, k)  # of the bad documents; of the good ones nearly all are called so
    votes = np.where(rng.random((20_000, k)) < np.where(truth[:, None], 0.995, hit), truth[:, None], ~truth[:, None]) * 2
    for p in (votes @ 3 ** np.arange(k)).tolist():
        counts[p] += 1
    post, table = quality.estimate(counts)
    assert np.abs(table[:, 1, 2] - 0.995).max() < 0.01 and np.abs(table[:, 0, 0] - hit).max() < 0.06
    assert np.mean([(post[p] > 0.5) == t for p, t in zip((votes @ 3 ** np.arange(k)).tolist(), truth, strict=True)]) > 0.97


def test_em_finds_accuracies_of_labellers_that_err_on_good_documents():
    rng = np.random.default_rng(0)
    k = len(quality.LABELLERS)
    truth = rng.random(20_000) < 0.8
    hit = np.linspace(0.7, 0.95, k)
    votes = np.where(rng.random((20_000, k)) < hit, truth[:, None], ~truth[:, None]) * 2
    patterns = (votes @ 3 ** np.arange(k)).tolist()
    post, table = quality.estimate(Counter(patterns))
    assert np.abs(table[:, 1, 2] - hit).max() < 0.04 and np.abs(table[:, 0, 0] - hit).max() < 0.06
    assert np.mean([(post[p] > 0.5) == t for p, t in zip(patterns, truth, strict=True)]) > 0.97


# decontamination


def edit_distance_inside(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_leaks_match_brute_force(spark):
    rng = random.Random(6)
    items = [(i, " ".join(words(rng, rng.choice([3, 12, 30]), 60))) for i in range(12)] + [(50, None), (51, "  "), (None, "nameless item of no use"), (99, "DUPLICATE item text here"), (98, "DUPLICATE item text here")]
    docs = []
    for d in range(120):
        text = " ".join(words(rng, 40, 60))
        if d % 3 == 0:
            passage = list(items[d % 12][1])
            for _ in range(rng.randrange(0, len(passage) // 8 + 1)):
                passage[rng.randrange(len(passage))] = rng.choice("abc ")
            text += "  \n" + "".join(passage).upper() + " " + " ".join(words(rng, 20, 60))
        docs.append((d, text))
    docs += [(500, "so duplicate  ITEM text here it is"), (501, None), (502, ""), (None, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (10**6, 300):
        got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.leaks(df, bench, block_chars=block).collect()}
        want = {}
        for d, t in docs:
            for i, p in items:
                if i is None or i == 99 or not decontaminate.normal(p) or not t:
                    continue
                p = decontaminate.normal(p)
                dist = edit_distance_inside(p, decontaminate.normal(t))
                if dist <= math.floor(len(p) * 0.1):
                    want[d, i] = dist
        assert got == want and (500, 98) in got
    kept = decontaminate.drop_leaks(df, bench)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((d is None, d or 0) for d, _ in docs if d not in {k[0] for k in want})


def test_leaks_on_odd_rows(spark):
    bench = spark.createDataFrame([(1, "w1x1 w2x2 and some more words")], "item_id long, text string")
    df = odd_documents(spark, clashing=True)
    assert decontaminate.leaks(df, bench).columns == ["doc_id", "item_id", "distance", "start", "end"]
    assert decontaminate.drop_leaks(df, bench).count() == df.count()
    assert decontaminate.leaks(no_documents(spark), bench).collect() == []
    assert decontaminate.drop_leaks(df, bench.limit(0)).count() == df.count()


# personal data


def luhn_number(rng, n):
    body = "4" + "".join(rng.choice("0123456789") for _ in range(n - 2))
    return next(body + c for c in "0123456789" if pii.luhn(body + c))


def test_permutations_are_bijections():
    for size in (1, 2, 7, 100, 1000):
        p = pii.Permutation(b"k", "t", size)
        assert sorted(map(p, range(size))) == list(range(size))
        even = lambda n: n % 2 == 0
        assert sorted(p(i, even) for i in range(0, size, 2)) == list(range(0, size, 2))
    assert [pii.Permutation(b"k", "t", 1000)(i) for i in range(9)] != [pii.Permutation(b"other", "t", 1000)(i) for i in range(9)]


def test_formats_stay_valid():
    rng = random.Random(1)
    swap = pii.Pseudonyms(b"key")
    cards = {luhn_number(rng, rng.choice([13, 16, 19])) for _ in range(300)}
    new = {swap.card(c) for c in cards}
    assert len(new) == len(cards) and all(pii.luhn(c) for c in new) and {len(c) for c in new} == {len(c) for c in cards}
    one = luhn_number(rng, 16)
    spaced = " ".join(one[i : i + 4] for i in range(0, 16, 4))
    assert swap.card(spaced).replace(" ", "") == swap.card(one)  # linked whatever the format
    assert swap.card("1234567890123456") is None
    iban = "GB82 WEST 1234 5698 7654 32"
    assert pii._mod97(swap.iban(iban).replace(" ", "")) == 1 and len(swap.iban(iban)) == len(iban) and swap.iban(iban) != iban
    assert swap.iban("GB00WEST12345698765432") is None
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", swap.ssn("123-45-6789")) and swap.ssn("000-12-3456") is None
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", swap.phone("+1 (988) 555-2485"))
    assert swap.phone("988-555-2485") == swap.phone("+1 988-555-2485")[3:]
    assert all(0 <= int(x) <= 255 for x in swap.ip("42.144.35.254").split(".")) and swap.ip("256.1.1.1") is None
    for s, form in (("2024-02-29", "%Y-%m-%d"), ("25/12/1999", "%d/%m/%Y"), ("12/25/1999", "%m/%d/%Y"), ("03/04/2001", "%m/%d/%Y"), ("01.02.2003", "%d.%m.%Y")):
        assert swap.date(s) != s and dt.datetime.strptime(swap.date(s), form) and len(swap.date(s)) == len(s)
    assert swap.date("2023-02-29") is None and swap.date("31/31/2000") is None
    days = {(dt.date(1990, 1, 1) + dt.timedelta(i)).isoformat() for i in range(3000)}
    assert len({swap.date(d) for d in days}) == 3000
    assert re.fullmatch(r"[a-z]{5}\.\d{2}@mail8\.example\.com", swap.email("bosbt.42@mail8.example.com"))


def test_equal_values_stay_linked_across_notations():
    swap = pii.Pseudonyms(b"key")
    of = lambda t: swap(t)[0]
    days = [dt.date(1990, 1, 1) + dt.timedelta(n) for n in range(0, 4000, 13)]
    seen = set()
    for d in days:
        new = dt.date.fromisoformat(of(d.isoformat()))
        assert (new.day > 12) == (d.day > 12)
        seen.add(new)
        assert of(f"{d:%d.%m.%Y}") == f"{new:%d.%m.%Y}"
        if d.day > 12:
            assert of(f"{d:%m/%d/%Y}") == f"{new:%m/%d/%Y}" and of(f"{d:%d/%m/%Y}") == f"{new:%d/%m/%Y}"
    assert len(seen) == len(days)
    for code, rest in (("353", "1 234 5678"), ("44", "20 7946 0958"), ("7", "495 123 45 67")):
        text, spans = swap(f"call +{code} {rest} now")
        assert [k for k, *_ in spans] == ["phone"] and text.startswith(f"call +{code} ") and rest not in text
        plain = lambda t: re.sub("[ -]", "", t)
        assert of("+" + plain(code + rest)) == plain(text[5:-4]) == plain(of(f"+{code}-{rest.replace(' ', '-')}"))
    secret = "0123456789ABCDEF0123456789ABCDEF"
    assert of(secret) == of(secret.lower()).upper() != secret
    assert swap("+12 and +353 1 is short, +1-2") == ("+12 and +353 1 is short, +1-2", [])


def test_texts_keep_all_else(spark):
    card = luhn_number(random.Random(5), 16)
    text = f"Mail a.b1@x.org, card {card} and {card[:4]} {card[4:8]} {card[8:12]} {card[12:]}; on 2020-01-31 from 10.0.0.1. Not 1234567890123456, v1.2.3 or 99.999.1.1! +1 (456) 555-2186"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "no data"), (1, text), (5, f"x{card[:6]} {card}")], "doc_id long, text string")
    got = pii.pseudonymise(df, b"key").collect()
    first = next(r for r in got if r.doc_id == 1)
    assert [p.kind for p in first.pii] == ["email", "card", "card", "date", "ip", "phone"]
    assert card not in first.text and "2020-01-31" not in first.text and "10.0.0.1" not in first.text
    assert "Not 1234567890123456, v1.2.3 or 99.999.1.1!" in first.text and len(re.findall("Mail|card|and|from", first.text)) == 4
    spans = {p.kind: first.text[p.start : p.end] for p in first.pii}
    assert spans["card"].replace(" ", "") in first.text and pii.luhn(spans["card"].replace(" ", ""))
    assert {r.doc_id: r.text for r in got if r.doc_id in (2, 3, 4)} == {2: None, 3: "", 4: "no data"}
    assert spans["card"].replace(" ", "") in next(r for r in got if r.doc_id == 5).text  # linked across documents
    odd = odd_documents(spark, clashing=True)
    named = pii.kinds_found(pii.pseudonymise(odd.withColumn("pii_email", F.lit("mine")), b"k"))
    assert named.agg(F.sum("pii_email")).first()[0] == 0 and named.columns.count("pii_email") == 1
    assert pii.pseudonymise(odd, b"k").drop("pii").exceptAll(odd.drop("pii")).count() == 0
    assert pii.pseudonymise(no_documents(spark), b"k").collect() == []


# dialogues


def render(turns):
    out = []
    for who in dict.fromkeys(r for _, r, _ in turns):
        if who == "system":
            continue
        text, mask = "", []
        for _, role, said in turns:
            head = "assistant" if role == who else "system" if role == "system" else f"user name={role}"
            text += f"<|im_start|>{head}\n"
            if role == who:
                mask.append((len(text), len(text) + len(said) + len("<|im_end|>")))
            text += f"{said}<|im_end|>\n"
        out.append((who, len(turns), text, mask, sum(b - a for a, b in mask)))
    return sorted(out)


def test_rotation(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "été 🙂"), (1, 3, "cy", ""), (1, 4, "ann", "Bye"), (2, 0, "system", "alone"), (3, 1, None, None), (3, None, "user", "late"), (None, 5, "x", "<|im_end|>no")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1)).withColumn("said", F.lit("x"))
    got = chat.rotate(df).collect()
    by = lambda c: sorted((r.perspective, r.n_turns, r.text, [tuple(m) for m in r["mask"]], r.trained_chars) for r in got if r.conv_id == c)
    assert by(1) == render([r[1:] for r in rows if r[0] == 1])
    assert by(2) == []
    assert sorted(r.perspective for r in got if r.conv_id == 3) == ["unknown", "user"]
    assert next(r for r in got if r.conv_id is None).text == "<|im_start|>assistant\n< |im_end|>no<|im_end|>\n"
    assert chat.rotate(df.limit(0)).collect() == []
    assert not re.search("Python|Pandas|Arrow", chat.rotate(df)._jdf.queryExecution().toString())


def test_long_and_crowded_dialogues(spark, monkeypatch):
    rows = [(1, i, f"p{i % 3}", f"t{i}") for i in range(25)] + [(2, 0, "a", f"m{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(chat, "PART_ROWS", 10)
    got = chat.rotate(df, part_turns=10).collect()
    for part in range(3):
        mine = sorted((r.perspective, r.n_turns, r.text, [tuple(m) for m in r["mask"]], r.trained_chars) for r in got if r.conv_id == 1 and r.part == str(part))
        assert mine == render([r[1:] for r in rows[part * 10 : min(25, part * 10 + 10)]])
    crowd = [r for r in got if r.conv_id == 2]
    assert sum(r.n_turns for r in crowd) == 50 and len(crowd) == 5 and {r.perspective for r in crowd} == {"a"}


def test_parts_are_rendered_for_every_participant(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_ROWS", 10)
    turns = [(i, "system" if i in (0, 12) or 20 <= i < 30 else "ann" if i < 10 else "bob", f"t{i}") for i in range(35)]
    rows = [(1, *t) for t in turns] + [(None, 7, "cy" if i else "dee", f"m{i:02}") for i in range(35)]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), part_turns=10).collect()
    shown = lambda r: (r.perspective, r.n_turns, r.text, [tuple(m) for m in r["mask"]], r.trained_chars)
    for part in range(4):
        mine = [t for t in turns if t[0] // 10 == part]
        want = render([*(t for t in turns if t[1] == "system" and t[0] // 10 < part), *mine, (99, "ann", ""), (99, "bob", "")])
        have = sorted(shown(r) for r in got if r.conv_id == 1 and r.part == str(part))
        assert [w[0] for w in have] == ["ann", "bob"]
        for h, w in zip(have, want, strict=True):
            assert h[1] == w[1] - 2 and w[2].startswith(h[2]) and h[3] == w[3][:-1]
    # equal turn numbers: cut in order, not scattered
    crowd = sorted((r.part, r.perspective, re.findall(r"m\d\d", r.text)) for r in got if r.conv_id is None)
    order = [f"m{i:02}" for i in range(1, 35)] + ["m00"]
    assert crowd == [(f"0.{k}" if k else "0", who, order[10 * k : 10 * k + 10]) for k in range(4) for who in ("cy", "dee")]
