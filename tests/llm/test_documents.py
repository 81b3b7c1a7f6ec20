"""Document operators against brute force on a small table with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from urnframe.llm import fm_index, katz, langid, line_spread, merkle_audit, pack_curve, pigeonhole, signature_join, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra int"
FOLD = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def folded(text):
    return words_of((text or "").translate(FOLD))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, blanks, nulls, ties and a very long text."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdeéßñ", k=rng.randint(1, 6))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    shared, line = text(60), "All rights reserved by everyone."
    out = []
    for i in range(120):
        body = text(rng.randint(1, 120))
        if i % 5 == 0:
            body = body + "\n" + shared + " " + text(20)
        if i % 4 == 0:
            body = line + "\n" + body
        out.append([i, body, "en" if i % 2 else "de", f"s{i % 12}", len(body), 0])
    base = text(200).split()
    for i in range(120, 150):
        own = list(base)
        for _ in range(i % 7):
            own[rng.randrange(len(own))] = "edit" + str(rng.randrange(50))
        out.append([i, " ".join(own), "en", "s0", 0, 0])
    out += [[150 + i, out[3][1], "en", "s1", 0, 0] for i in range(5)]
    out += [[160, None, None, None, None, None], [161, "", "en", "s1", 0, 0], [162, " \n\t ", "en", "s2", 0, 0]]
    out += [[163, "Word", None, "s3", 4, 0], [164, "1 2 3", "en", None, 5, 0], [165, "a " * 3000 + "end", "en", "s1", 0, 0]]
    out += [[166, "Tie TIE tie tIE\x0btie", "de", "s2", 0, 0], [None, text(30), "en", "s1", 0, 0], list(out[7])]
    return [tuple(r) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing_holds_each_id_once(docs, rows):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want[(doc_id, np.array(ids, "<u4").tobytes())] += 1
    pieces = pack_curve.pack_documents(docs, 64).toPandas()
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        total = int(own["length"].sum())
        assert own["offset"].tolist() == [0, *np.cumsum(own["length"])[:-1]]
        assert total <= 64 and total & (total - 1) == 0
    got = Counter()
    once = pieces[~pieces["doc_id"].isin([7])]  # the repeated row's pieces interleave
    for doc_id, own in once.groupby("doc_id", dropna=False):
        own = own.sort_values("start")
        body = b"".join(own["ids"])
        assert len(body) == 4 * own["doc_tokens"].iloc[0] and own["start"].tolist() == [0, *np.cumsum(own["length"])[:-1]]
        got[(None if doc_id != doc_id else int(doc_id), body)] += 1
    assert got == Counter({k: v for k, v in want.items() if k[0] != 7})
    assert pieces.loc[pieces["doc_id"] == 7, "length"].sum() == 2 * pieces.loc[pieces["doc_id"] == 7, "doc_tokens"].iloc[0]


def test_tokens_equal_the_library(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    tokens = pack_curve.tokens_of("byte_bpe_50k")
    texts = ["", " ", "a", " a", "a ", "a  b", "a \n b\n\nc", "it's don't", "x　y z", "<|endoftext|> a", "é ß 12,5 …", "a\tb c\r\n"]
    for text in texts:
        assert np.frombuffer(tokens.encode(text), "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_all_texts_at_once_equal_the_library(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rng = np.random.default_rng(5)
    spaces = [c for c in map(chr, range(0x3001)) if c.isspace()]
    marks = [*"aZ1é中!🙂 ", "'s", "22", "...", "<|endoftext|>", *" " * 9, "\u200b", "\ufeff", *spaces]
    texts = ["".join(marks[k] for k in rng.integers(0, len(marks), rng.integers(0, 14))) for _ in range(3000)]
    texts += [None, "", " ", "a", *[f"a {c}b" for c in spaces], *[f"a{c} b" for c in spaces]]
    ids, bounds = pack_curve.tokens_of("byte_bpe_50k").encode_all(pa.array(["x", *texts]).slice(1))
    for text, low, high in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert ids[low:high].tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_each_different_word_is_encoded_once(spark, monkeypatch):
    encoding = pack_curve.tokens_of("byte_bpe_50k").encoding
    sizes, encode = [], encoding.encode_ordinary
    words = [f"w{i:06d}" for i in range(250_000)]
    texts = [" ".join(words), " ".join(words), "z " + " ".join(words[::-1])]
    rows = SimpleNamespace(select=lambda *_: SimpleNamespace(mapInArrow=lambda run, _: run))
    task = SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(texts)], ["doc_id", "text"])
    with monkeypatch.context() as patch:
        patch.setattr(pack_curve, "TaskContext", task)
        patch.setattr(encoding, "encode_ordinary", lambda text: sizes.append(len(text)) or encode(text))
        out = pa.Table.from_batches(pack_curve.token_table(rows)([batch])).to_pylist()
    assert sum(sizes) < 8 * 250_000 + 100 and len(sizes) < 10
    assert [np.frombuffer(x["ids"], "<u2").tolist() for x in out] == [[*encode(x), 0] for x in texts]


def test_hilbert_neighbours_touch():
    side = np.arange(8)
    points = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    place = pack_curve.hilbert(points, 3)
    assert sorted(place) == list(range(512))
    steps = np.abs(np.diff(points[np.argsort(place)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_katz_is_exact_and_normalised(docs, rows):
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    got = katz.score(docs.select("doc_id", "text", (katz.remainder("doc_id", 7) != 2).alias("train"), "extra")).collect()
    texts = [(i, [*folded(t), None]) for i, t, *_ in rows]
    one, two = Counter(), Counter()
    for i, t in texts:
        if not held(i):
            one.update(t)
            two.update(zip(["<s>", *t[:-1]], t))
    numbers = lambda c: np.array(
        [sum(v == r for v in c.values()) for r in range(1, katz.K + 2)] + [len(c), sum(c.values())]
    )
    model = katz.Model({1: numbers(one), 2: numbers(two)})
    uses = {**one, "<s>": one[None]}
    single = lambda w: float(model.single(np.array([one[w]]))[0])
    pair = lambda h, w: float(katz.kept(np.array([two[h, w]]), model.discount[1])[0]) / uses[h]
    assert sum(map(single, one)) + model.left == pytest.approx(1)
    seen, lower = Counter(), Counter()
    for h, w in two:
        seen[h] += pair(h, w)
        lower[h] += single(w)
    weight = {h: (1 - seen[h]) / (1 - lower[h]) for h in seen}
    h = two.most_common(1)[0][0][0]
    total = sum(pair(h, w) if two[h, w] else weight[h] * single(w) for w in one) + weight[h] * model.left
    assert total == pytest.approx(1)
    want = Counter()
    for i, t in texts:
        score = sum(
            np.log10(pair(h, w)) if two[h, w] else np.log10(single(w) * weight.get(h, 1)) for h, w in zip(["<s>", *t[:-1]], t)
        )
        base = sum(np.log10((one[w] + 1) / (sum(one.values()) + len(one) + 1)) for w in t)
        want[i, held(i), len(t), sum(one[w] > 0 for w in t), sum(one.values()), round(base, 5), round(float(score), 5)] += 1
    assert want == Counter((*r[:5], round(r[5], 5), round(r[6], 5)) for r in got)


def test_line_spread_counts_sites(docs, rows):
    site = lambda r: r[3] or ""
    spread = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if line.strip(" \t\r"):
                spread.setdefault(line.strip(" \t\r"), set()).add(site(r))
    wide = {x for x, s in spread.items() if len(s) >= 3}
    want = Counter()
    for r in rows:
        if r[1] is None:
            want[r[0], None] += 1
            continue
        lines = r[1].split("\n")
        rest = [x for x in lines if x.strip(" \t\r") not in wide]
        want[r[0], "\n".join(rest) if any(x.strip(" \t\r") for x in rest) else r[1]] += 1
    out = line_spread.without_boilerplate(docs, sites=3)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == want
    counts = line_spread.line_spread(docs, sites=3).where("exact").collect()
    assert counts and all(r.n_sites >= 3 for r in counts)


def _distance(pattern, text):
    """Least edits from the pattern to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        last, row = row, [i] + [0] * len(text)
        for j, b in enumerate(text, 1):
            row[j] = min(last[j - 1] + (a != b), last[j] + 1, row[j - 1] + 1)
    return min(row)


def test_pigeonhole_finds_what_is_within_the_budget(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choices("abcd ef", k=n))
    items = [(i, text(rng.randint(40, 120))) for i in range(12)] + [(12, None), (13, "short"), (None, text(50))]
    rows = []
    for i in range(60):
        body = text(80)
        if i % 3 == 0:
            own = list(items[i % 12][1])
            for _ in range(i % 6):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([[], ["x"], ["x", own[at]]])
            body += "".join(own).upper() + text(30)
        rows.append((i, body))
    rows += [(60, None), (61, "")]
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = set()
    for i, body in rows:
        for n, item in items:
            own = pigeonhole.fold(item)
            if n is not None and len(own) >= pigeonhole.LEAST:
                d = _distance(own, pigeonhole.fold(body))
                if d <= int(0.05 * len(own)):
                    want.add((i, n, d))
    for block in (pigeonhole.BLOCK, 300):
        got = pigeonhole.contaminations(docs, bench, block=block).collect()
        assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and len(got) == len(want)
    kept = {r.doc_id for r in pigeonhole.without_contamination(docs, bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _, _ in want}
    assert pigeonhole.contaminations(docs, bench.limit(0)).count() == 0


def test_pigeonhole_finds_short_items_as_whole_words(spark):
    items = [(1, "Paris?"), (2, "cat"), (3, "what is a catalogue of it"), (4, " "), (5, "x")]
    rows = [(1, "In PARIS? no"), (2, "a catalogue; concat, Cat."), (3, "scatter paris"), (4, "so what is a catalgue of it"), (5, "")]
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {tuple(r) for r in pigeonhole.contaminations(docs, bench).collect()}
    assert got == {(1, 1, 0, 3, 9), (2, 2, 0, 21, 24), (4, 3, 1, 3, 27)}
    kept = {r.doc_id for r in pigeonhole.without_contamination(docs, bench).collect()}
    assert kept == {3, 5}


def _components(rows, n=5):
    sets = []
    for _, text, *_ in rows:
        w = folded(text)
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= 80 * len(a | sets[j]) and sets[j]:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return Counter((r[0], len(s), least.get(find(i)) if r[0] is not None else None) for i, (r, s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("chunk", [signature_join.CHUNK, 2000])
def test_signature_join_loses_no_link(docs, rows, chunk, monkeypatch):
    monkeypatch.setattr(signature_join, "CHUNK", chunk)  # the small one splits the group of near copies
    got = Counter(tuple(r) for r in signature_join.similar_documents(docs).collect())
    assert got == _components(rows)


def test_signature_tree_prunes_nothing_similar():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64)
        for _ in range(3):
            own = base.copy()
            own[rng.random(len(own)) < rng.random() * 0.2] += np.uint64(1)
            sets.append(np.unique(own))
    links = signature_join.join_sets(sets, np.arange(len(sets)), np.ones(len(sets), bool), 80)
    root = np.arange(len(sets))
    want = np.arange(len(sets))
    for r, pairs in ((root, links), (want, [(i, j) for i in range(120) for j in range(i) if signature_join.similar(sets[i], sets[j], 80)])):
        for i, j in pairs:
            r[r == r[i]] = r[j]
    same = lambda r: r[:, None] == r[None, :]
    assert (same(root) == same(want)).all()


@pytest.mark.parametrize("wide", [signature_join.WIDE, 50])
def test_boilerplate_makes_no_wide_jobs(spark, monkeypatch, wide):
    """Texts that share a passage but are not similar are not compared chunk by chunk; near copies among them are found."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage, rows = [word() for _ in range(30)], []
    for i in range(300):
        own = passage + [word() for _ in range(rng.randint(15, 40))]
        if i % 10 == 1:
            own = rows[-1][1].split()
            own[-1] = word()
        rows.append((i, " ".join(own), "en", "s1", 0, 0))
    rows += [(i, None if i % 2 else rows[i][1], "en", "s1", 0, 0) for i in range(20)]
    dealt, deal = [], signature_join._dealt
    monkeypatch.setattr(signature_join, "_dealt", lambda jobs, percent: (dealt.append(jobs.count()), deal(jobs, percent))[1])
    monkeypatch.setattr(signature_join, "WIDE", wide)
    monkeypatch.setattr(signature_join, "CHUNK", 1000 if wide > len(rows) else 10**6)
    got = Counter(tuple(r) for r in signature_join.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == _components(rows)
    assert 60 <= sum(dealt) <= 150  # the near copies, one in ten with its original; not the 300


def test_signature_join_tests_few_pairs_that_are_not_similar(monkeypatch):
    rng, similar = np.random.default_rng(2), signature_join.similar
    for size in (40, 400, 4000):
        base = rng.integers(0, 2**63, size).astype(np.uint64)
        sets = []
        for _ in range(60):  # variants of one set, any two too different
            own = base.copy()
            own[rng.random(size) < 0.15] = rng.integers(0, 2**63, 1).astype(np.uint64)
            own[:: 7] += rng.integers(1, 2**40, len(own[::7])).astype(np.uint64)
            sets.append(np.unique(own))
        calls = []
        monkeypatch.setattr(signature_join, "similar", lambda a, b, percent: (calls.append(1), similar(a, b, percent))[1])
        assert signature_join.join_sets(sets, np.arange(60), np.ones(60, bool), 80) == []
        assert len(calls) <= 180  # of 1,770 pairs


@pytest.mark.parametrize("hot", [fm_index.HOT, 1])
def test_fm_index_removes_repeats(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(fm_index, "HOT", hot)
    seen = Counter()
    for _, text, *_ in rows:
        w = words_of(text)
        seen.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    want = Counter()
    for doc_id, text, *_ in rows:
        w = words_of(text)
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    out = fm_index.without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert Counter(tuple(r) for r in out.collect()) == want


def test_fm_index_counts():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 6, n).astype(np.uint64) for n in (1, 5, 40, 90)]
    index = fm_index.FMIndex(texts)
    body = index.body[index.starts[2] : index.starts[2] + 40]
    got = index.statistics(body, 10)
    plain = ["".join(map(str, t)) for t in texts]
    for e in range(40):
        best = 0
        for n in range(1, min(10, e + 1) + 1):
            run = plain[2][e - n + 1 : e + 1]
            if sum(t[i : i + n] == run for t in plain for i in range(len(t))) < 2:
                break
            best = n
        assert got[e] == best


def test_language_and_toxicity_learn(spark):
    rng = random.Random(1)
    tongues = {"aa": "abcde", "bb": "defgh", "cc": "ghijk"}
    rows, labels = [], []
    for i in range(300):
        lang = list(tongues)[i % 3]
        words = ["".join(rng.choices(tongues[lang], k=4)) for _ in range(30)]
        if i % 4 == 0:
            words[rng.randrange(30)] = "vilest"
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(i % 4 == 0)))
    rows += [(300, None, "aa"), (301, "123 45", None), (302, "", "bb")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = langid.identify(docs, langid.fit(docs.where("doc_id < 200"))).collect()
    assert len(found) == 303
    right = sum(r.lang_pred == rows[r.doc_id][2] for r in found if 200 <= r.doc_id < 300)
    assert right >= 95
    assert {r.lang_pred for r in found if r.doc_id >= 300} == {"und"}
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit(docs.where("doc_id < 200"), marks)
    scored = toxicity.rejected(docs, model).collect()
    assert len(scored) == 303 and all(0 <= r.score <= 1 for r in scored)
    assert sum((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in scored if 200 <= r.doc_id < 300) >= 95


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert pack_curve.pack_documents(empty).count() == 0
    assert katz.score(empty.withColumn("train", F.lit(True))).count() == 0
    assert line_spread.without_boilerplate(empty).count() == 0
    assert signature_join.similar_documents(empty).count() == 0
    assert fm_index.without_repeats(empty).count() == 0
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    assert toxicity.score_texts(empty, toxicity.fit(empty, labels)).count() == 0


def test_merkle_audit_finds_damage(spark):
    rows = [(i, f"u{i}", "x" * (i % 50)) for i in range(9000)] + [(5, "u5", "second"), (None, "n", None)]
    first = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert merkle_audit.compare_replicas(first, first, "page_id", ["url", "html"]).count() == 0
    bad = [r for r in rows if r[0] not in (17, 8000)]
    bad = [(i, u, "y" if i == 4100 else h) for i, u, h in bad] + [(20_000, "new", ""), (-3, None, None)]
    bad.remove((5, "u5", "second"))
    bad[-3] = (None, "n", "")
    second = spark.createDataFrame(bad, "page_id bigint, url string, html string")
    got = {(r.record, r.kind) for r in merkle_audit.compare_replicas(first, second, "page_id", ["url", "html"]).collect()}
    assert got == {(17, "missing"), (8000, "missing"), (4100, "altered"), (5, "altered"), (20_000, "extra"), (-3, "extra"), (None, "altered")}
    none = second.limit(0)
    assert merkle_audit.compare_replicas(first.limit(100), none, "page_id", ["html"]).where("kind = 'missing'").count() == 100
