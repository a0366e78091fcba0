"""The llm operators do the whole of their job: cases that earlier cuts lost, against independent brute force."""

import gzip
import json
import math
import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, html_text, links, pieces, pii, quality, warc
from lodestone.llm.html_text import main_text
from lodestone.llm.line_dedup import _kinds, _set, dedup_lines, signatures
from lodestone.llm.queries import MODEL_PATH
from lodestone.llm.scratch import Scratch

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def grams(line):
    return {line[i : i + 5] for i in range(len(line) - 4)} or {line}


def test_line_dedup_near_copies(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice(LETTERS) for _ in range(r.randint(3, 8)))
    lines, pairs = [], 0
    for k in range(240):
        line = "".join(r.choice(LETTERS + "0123456789/") for _ in range(300)) if k % 6 == 0 else " ".join(word() for _ in range(r.randint(5, 30)))
        at = r.randrange(len(line))
        near = line[:7] + "Q" + line[7:] if k % 6 == 0 else line[:at] + "Q" + line[at + 1 :]
        lines += [line, near]
        a, b = grams(line), grams(near)
        pairs += 5 * len(a & b) >= 4 * len(a | b)
    lines += ["abc", "ab", "abcde", "日本語テキスト処理", "日本語テキスト処理。"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {x.doc_id: x.n_removed for x in dedup_lines(spark, docs).collect()}
    assert pairs > 180
    # unrelated lines are far apart, so every component is a line and its copy
    missed = []
    for i in range(0, 480, 2):
        a, b = grams(lines[i]), grams(lines[i + 1])
        assert got[i] == 0
        alike = 5 * len(a & b) >= 4 * len(a | b)
        assert got[i + 1] <= alike
        missed += [i] * (alike and not got[i + 1])
    # at 0.8 a pair is missed five times in a thousand
    assert len(missed) <= 3
    a, b = grams(lines[-2]), grams(lines[-1])
    assert [got[i] for i in range(480, 485)] == [0, 0, 0, 0, int(5 * len(a & b) >= 4 * len(a | b))]


def test_line_shingles(spark):
    """Every shingle at every offset is compared, of wide characters too; lines have the same keys everywhere."""
    rows = [(n, "".join(chr(0x1F600 + i % 50) if i % 7 == 0 else chr(0x4E00 + (7 * i * i + n) % 300) if i % 3 else "x" for i in range(n))) for n in (1, 4, 5, 6, 63, 64, 65, 128, 500, 5000)]
    lines = spark.createDataFrame(rows, "id long, line string")
    compared = {x.id: len(x.s) for x in lines.select("id", _set(F.col("line")).alias("s")).collect()}
    assert compared == {n: len(grams(line)) for n, line in rows}
    # the keys of lines that Python signs are those that Spark makes
    docs = lines.select(F.col("id").alias("doc_id"), F.col("line").alias("text"))
    kinds = _kinds(spark, docs, "doc_id", "text", Scratch(spark, "test"))
    want = {(x.k1, x.k2): x.id for x in lines.select("id", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2")).collect()}
    assert {(x.k1, x.k2): x.doc for x in kinds.collect()} == want


def test_line_signatures():
    """Values of two lines agree as often as their sets of shingles do, for short lines too."""
    r = random.Random(8)
    for n in (8, 12, 30, 200, 1500):
        agreed = likeness = 0.0
        for _ in range(60):
            a = [r.choice(LETTERS) for _ in range(n)]
            b = a[: n - max(1, n // 12)] + [r.choice(LETTERS) for _ in range(max(1, n // 12))]
            a, b = "".join(a), "".join(b)
            x, y = signatures([a, b])
            agreed += (x == y).mean()
            likeness += len(grams(a) & grams(b)) / len(grams(a) | grams(b))
        assert abs(agreed - likeness) / 60 < 0.05, n


def test_line_dedup_recall_by_length(spark):
    """Copies at 0.8 to 0.9 of short and of long lines, on either side of each doubling."""
    r = random.Random(12)
    lines = []
    for n in (12, 20, 30, 60, 100, 125, 131, 140, 200, 260, 300, 500, 520, 1000, 2050):
        for _ in range(24):
            line = "".join(r.choice(LETTERS) for _ in range(n))
            while True:
                near = list(line)
                for _ in range(max(1, n // 60)):
                    at = r.randrange(len(near))
                    near[at : at + 1] = [r.choice("QRS")] * r.randint(0, 2) if n > 60 else [r.choice("QRS")]
                if r.random() < 0.5:
                    near += [r.choice(LETTERS) for _ in range(n // 12)]
                a, b = grams(line), grams("".join(near))
                if 5 * len(a & b) >= 4 * len(a | b) or n < 40:
                    break
            lines.append((line, "".join(near), 5 * len(a & b) >= 4 * len(a | b)))
    docs = spark.createDataFrame([x for i, (a, b, _) in enumerate(lines) for x in ((2 * i, a), (2 * i + 1, b))], "doc_id long, text string")
    got = {x.doc_id: x.n_removed for x in dedup_lines(spark, docs).collect()}
    alike = [i for i, x in enumerate(lines) if x[2]]
    assert all(got[2 * i] == 0 and got[2 * i + 1] <= x[2] for i, x in enumerate(lines))
    found = sum(got[2 * i + 1] for i in alike)
    assert len(alike) > 250 and found >= 0.97 * len(alike)


def test_line_dedup_native(spark, monkeypatch):
    """No line is handed to Python; copies with 16 to 34 chosen shingles, signed one way, the other or both, are found."""
    r = random.Random(21)
    rows, alike = [], 0
    for k in range(120):
        line = "".join(r.choice(LETTERS) for _ in range(105 + k))
        at = r.randrange(len(line))
        near = line[:at] + "Q" + line[at + 1 :]
        rows += [(2 * k, line), (2 * k + 1, near)]
        alike += 5 * len(grams(line) & grams(near)) >= 4 * len(grams(line) | grams(near))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(docs), name, None)
    got = {x.doc_id: x.n_removed for x in dedup_lines(spark, docs).collect()}
    assert alike == 120 and not any(got[2 * k] for k in range(120))
    assert sum(got[2 * k + 1] for k in range(120)) >= 118


def test_line_dedup_odd_lines(spark):
    """Rulers of any length are one line; ids may be any number; rows that repeat an id lose the same places."""
    big = 2**62
    rows = [(big, "-" * 40 + "\nfirst line of all\n" + "=-" * 400), (-big, "-" * 700), (3, "=-" * 90), (4, "first line of all\n" + "-" * 5), (5, "\n\n"), (5, "first line of all\n\n")]
    got = sorted((x.doc_id, x.text, x.n_removed) for x in dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # a short ruler is the same set of shingles; of each kind the line of the least id stays
    assert got == sorted([(-big, "-" * 700, 0), (3, "=-" * 90, 0), (4, "first line of all", 1), (5, "\n", 1), (5, "\n", 1), (big, "", 3)])


def test_line_dedup_large_group(spark, monkeypatch):
    """Copies of one line that are nearly alike among themselves give few pairs for full comparison, and lose no link."""
    r = random.Random(33)
    base = [r.choice(LETTERS) for _ in range(400)]
    lines = []
    for i in range(100):
        line = list(base)
        for at in r.sample(range(400), 6 if i else 0):
            line[at] = r.choice("QRSTUV")
        lines.append("".join(line))
    # the line all come from is alike with each of them: one group has it, the other has not
    lines = [*lines[1:], *[x[::-1] for x in lines]]
    compared = []
    cut = Scratch.cut

    def counted(self, df, name):
        out = cut(self, df, name)
        compared.extend([out.count()] * (name == "confirmed"))
        return out

    monkeypatch.setattr(Scratch, "cut", counted)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {x.doc_id: x.n_removed for x in dedup_lines(spark, docs).collect()}
    sets = [grams(x) for x in lines]
    links_of = {i: {j for j in range(199) if j != i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} for i in range(199)}
    first = {}
    for i in range(199):
        reach, todo = {i}, [i]
        while todo:
            new = links_of[todo.pop()] - reach
            reach |= new
            todo += new
        first[i] = min(reach)
    assert sum(first[i] != i for i in range(99, 199)) == 99 and sum(first[i] != i for i in range(99)) < 50
    # a link at 0.8 is missed eight times in a thousand
    assert all(got[i] <= (first[i] != i) for i in range(199)) and sum(first[i] != i for i in range(199)) - sum(got.values()) <= 2
    assert compared[-1] < 5 * len(lines)  # the comparison of whole buckets


def test_line_dedup_chance_meetings(spark, monkeypatch):
    """Lines that share a window by chance are told apart by their sketches, before texts or shingles are taken for them."""
    r = random.Random(40)
    words = ["".join(r.choice(LETTERS) for _ in range(r.randint(2, 7))) for _ in range(40)]
    lines = [" ".join(r.choice(words) for _ in range(r.randint(30, 60))) for _ in range(500)]
    copies = [line[:90] + "Q" + line[91:] for line in lines[:60]]
    taken = []
    cut = Scratch.cut

    def counted(self, df, name):
        out = cut(self, df, name)
        taken.extend([out.count()] * (name == "texts"))
        return out

    monkeypatch.setattr(Scratch, "cut", counted)
    docs = spark.createDataFrame(list(enumerate(lines + copies)), "doc_id long, text string")
    got = {x.doc_id: x.n_removed for x in dedup_lines(spark, docs).collect()}
    assert not any(got[i] for i in range(500)) and sum(got[i] for i in range(500, 560)) == 60
    # 425 lines without sketches, 328 with them; 120 are copies or have one
    assert 120 <= sum(taken) < 400


def test_links_meet_once(spark):
    """A pair of a bucket is compared once, and every pair that no link connects is."""
    met = []

    def verify(pairs):
        met.extend((x.a, x.b) for x in pairs.collect())
        return pairs.where("a = 11 and b = 13")

    rows = [(1, 1, 1), (1, 2, 1), (1, 3, 1), (2, 4, 1), (2, 5, 1), *[(3, i, 1) for i in range(11, 16)]]
    label = links.link(spark.createDataFrame(rows, "bucket long, id long, size int"), verify, Scratch(spark, "test"), 80, lambda rows: rows.select(F.col("id").alias("a"), F.col("id").alias("b")))
    assert {(x.id, x.component) for x in label.collect()} == {(11, 11), (13, 11)}
    assert sorted(met) == [(1, 2), (1, 3), (2, 3), (4, 5), *[(a, b) for a in range(11, 16) for b in range(a + 1, 16)]]


def test_spaced_instances():
    """Identifiers of several words are instances as a whole, in their brackets."""
    for text, want in [("at (523) 555-1055 now", "(523) 555-1055"), ("at 555 019 943, now", "555 019 943"), ("at (523)555-1055 now", "(523)555-1055"), ("at (555 019 943) now", "555 019 943")]:
        assert want in [text[s:e] for _, s, e in pii.instances(text, [])], text
    assert not list(pii.instances("in 12 of 34 years, 1 2 3 4", []))


def test_pii_bootstrap_grows(spark):
    """Found instances carry a context that holds no seed at all to others."""
    rows = [f"write to the desk using a{i}@example.com today" for i in range(36)]
    # found by the seeds' context, and seen in another context too
    rows += [f"write to the desk using b{i}@local today. my alias remains b{i}@local forever" for i in range(4)]
    # known by that second context only
    rows += ["my alias remains z9@local forever"]
    rows += [f"please dial desk +1 555 010 10{i}0 soon" for i in range(9)] + ["please dial desk (523) 555-1055 soon"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {x.doc_id: x for x in pii.find_pii(spark, docs).collect()}
    at = rows[40].index("z9")
    assert got[40].spans == f"email:{at}:{at + 8}" and got[40].n_added == 1
    assert [got[i].n_added for i in (0, 36, 39)] == [0, 2, 2]
    at = rows[50].index("(")
    assert got[50].spans == f"phone:{at}:{at + 14}"


M64 = 2**64 - 1


def mixed(h):
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & M64
    h = (h ^ h >> 27) * 0x94D049BB133111EB & M64
    return h ^ h >> 31


def agenda(model, text, salt, dropout):
    """Merge-dropout written plainly: each segment's best candidate by rank, then place, is made or skipped for good."""
    symbols = [int(model.char_symbol[ord(c)]) for c in " " + text]
    out, at = [], 0
    while at < len(symbols):
        end = at + 1
        lone = lambda i: bool(model.lone[ord((" " + text)[i])])
        while end < len(symbols) and not lone(end) and not lone(end - 1) and not ((" " + text)[end] == " " and (" " + text)[end - 1] != " "):
            end += 1
        key = mixed(salt ^ mixed(at + 1))
        parts = [(i, symbols[i]) for i in range(at, end)]
        skipped = set()
        while True:
            best = None
            for k in range(len(parts) - 1):
                (i, a), (_, b) = parts[k], parts[k + 1]
                rank = model.merges.get((a, b))
                if rank is not None and (i, a, b) not in skipped and (best is None or (rank, k) < best[:2]):
                    best = rank, k, i, a, b
            if best is None:
                break
            rank, k, i, a, b = best
            if mixed(key ^ mixed((a << 32 | b) + mixed(i - at + 1) & M64)) < int(dropout * 2**64):
                skipped.add((i, a, b))
            else:
                parts[k : k + 2] = [(i, int(model.piece_of_rank[rank]))]
        out += [s for _, s in parts]
        at = end
    return out


def test_dropout_by_occurrence():
    """Every occurrence is cut by its own key, as a plain agenda cuts it."""
    with open(MODEL_PATH, "rb") as f:
        model = pieces.Model(f.read())
    r = random.Random(2)
    words = ["international", "understanding", "the", "of", "preparations", "a", "counterrevolutionaries" * 3]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 12))) + r.choice(["", " ", "  x", "."]) for _ in range(60)]
    salt = pieces.salts(np.arange(60), 5)
    for dropout in (0.0, 0.1, 0.5):
        ids, off = model.encode(texts, salt, dropout)
        for i, t in enumerate(texts):
            assert ids[off[i] : off[i + 1]].tolist() == agenda(model, t, int(salt[i]), dropout), (t, dropout)
    ids, off = model.encode(["international"] * 2000, pieces.salts(np.arange(2000), 5), 0.5)
    assert len({tuple(ids[a:b]) for a, b in zip(off[:-1], off[1:])}) > 500
    ids, off = model.encode([" ".join(["international"] * 50)], pieces.salts(np.arange(1), 5), 0.5)
    marks = np.flatnonzero([model.pieces[i][0].startswith(chr(pieces.MARK)) for i in ids])
    assert len({tuple(x) for x in np.split(ids, marks[1:])}) > 30


PARA = "<p>" + "plain words of the article go on here " * 12 + "</p>"


def test_html_contract_cases():
    text = " ".join(["plain words of the article go on here"] * 12)
    assert main_text("<html><head><title>T</title><body><p>hello") == "hello"
    assert main_text(f'<nav>menu</nav><div class="content no-sidebar">{PARA}</div>') == text
    assert main_text(f'<main><section class="widget">{PARA}</section></main>') == text
    assert main_text(f'<div><div class="article-header"><h1>Title</h1></div>{PARA}</div>') == "Title\n\n" + text
    assert main_text(f"<form><nav>menu</nav><h1>Head</h1>{PARA}<footer>foot</footer></form>") == "Head\n\n" + text
    # reader comments stay furniture, however dense they are
    assert main_text(f'<article>{PARA}<div id="comments">{PARA * 6}</div></article>') == text
    # depth costs no more than length; the region is the smallest element with nine tenths of the text
    assert main_text("<div>x" * 20_000).count("x") == 18_000


def test_html_clusters_decide(monkeypatch):
    """On a page of unmarked elements it is density that tells the article from lists of links."""
    links_ = "<ul>" + "".join(f"<li><a href='#'>Link {i}</a></li>" for i in range(30)) + "</ul>"
    page = f"<body><div>{links_}{PARA * 4}{links_}</div></body>"
    kept = main_text(page).count("Link")
    monkeypatch.setattr(html_text, "_clusters", lambda ratio: [True] * len(ratio))
    assert kept <= 4 and main_text(page).count("Link") == 60


def test_html_clusters_plainly():
    r = random.Random(3)
    for _ in range(50):
        ratio = [r.choice([0.0, r.uniform(0, 200)]) for _ in range(r.randint(1, 30))]
        soft = []
        for i in range(len(ratio)):
            weight = {j: math.exp(-((i - j) ** 2) / 4.5) for j in range(len(ratio)) if abs(i - j) <= 2}
            soft.append(sum(ratio[j] * w for j, w in weight.items()) / sum(weight.values()))
        mean = sum(soft) / len(soft)
        sd = (sum((x - mean) ** 2 for x in soft) / len(soft)) ** 0.5
        assert all(got == (x >= sd / 2) for got, x in zip(html_text._clusters(ratio), soft) if abs(x - sd / 2) > 1e-9)


def test_warc_of_other_writers(tmp_path):
    """Records of any type, header names in any case and spacing, folded and missing fields."""
    rows = [b"WARC/1.0\r\nwarc-type:warcinfo\r\nContent-Length:  3\r\n\r\nabc\r\n\r\n", b"WARC/1.1\r\nWARC-Type: request\r\nX-Long: a\r\n  b\r\ncontent-length: 0\r\n\r\n\r\n\r\n", b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <x>\r\nCONTENT-LENGTH: 2\r\n\r\n\r\n\r\n\r\n"]
    source = f"{tmp_path}/in.warc.gz"
    with gzip.open(source, "wb") as f:
        f.write(b"".join(rows))
    assert warc.normalise(source, f"{tmp_path}/out.warc.gz", f"{tmp_path}/out.idx") == 3
    got = list(warc.read(f"{tmp_path}/out.warc.gz", f"{tmp_path}/out.idx"))
    assert [(f["warc-type"], block) for f, block in got] == [("warcinfo", b"abc"), ("request", b""), ("metadata", b"\r\n")]
    assert got[1][0]["x-long"] == "a b"
    index = [json.loads(x) for x in open(f"{tmp_path}/out.idx")]
    with open(f"{tmp_path}/out.warc.gz", "rb") as f:
        raw = f.read()
    assert [gzip.decompress(raw[x["offset"] : x["offset"] + x["length"]]) for x in index] == rows
    assert [x["id"] for x in index] == [None, None, "<x>"]


def test_leaks_against_all_places(spark):
    """Copies with the most edits allowed, at any place, against edit distance at every place of every document."""
    r = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    items = [[r.choice(words) for _ in range(n)] for n in (5, 9, 14, 20, 33, 48, 70, 120)]
    docs = []
    for k in range(96):
        x = list(items[k % 8])
        for _ in range(int(len(x) * 0.2) if k % 3 else 0):
            at, kind = r.randrange(len(x)), r.randrange(3)
            x[at : at + (kind != 0)] = [] if kind == 2 else [r.choice(words)]
        docs.append([r.choice(words) for _ in range(r.randrange(90))] + x + [r.choice(words) for _ in range(r.randrange(90))])
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.distance for x in decontaminate.leaks(spark, frame, bench).collect()}

    def least(item, doc):
        row = [0] * (len(doc) + 1)
        for i, a in enumerate(item, 1):
            new = [i]
            for j, b in enumerate(doc, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        return min(row)

    true = {(d, i): cost for d, doc in enumerate(docs) for i, item in enumerate(items) if (cost := least(item, doc)) <= int(len(item) * 0.2 + 1e-9)}
    assert set(got) <= set(true) and all(got[k] == true[k] for k in got)
    exact = [k for k, cost in true.items() if not cost]
    assert len(true) >= 90 and len(got) >= 0.95 * len(true) and all(k in got for k in exact)


def test_co_training_exchange():
    """What the text knows reaches the metadata view by unlabelled rows alone."""
    r = np.random.default_rng(4)
    y = r.integers(0, 2, 400).astype(float)
    places = np.where(np.arange(400) % 2, 0, 1)  # of labelled rows the metadata tells nothing
    text = np.stack([y * 4 + r.normal(size=400), r.normal(size=400)], 1)

    class Loose(quality.Unlabelled):
        def __init__(self):
            pass

        def sure_by_text(self, view):
            bad = quality._sigmoid(view.logit(np.array([[5.0, 0.0]])))[0] > 0.97
            return [(5, True, 300), (6, False, 300)] if bad else []

        def sure_by_meta(self, view):
            return []

    known = (text, quality.metadata_features(places))
    alone, taught = (quality.co_train(np.zeros(0, np.uint64), known, y, x) for x in (None, Loose()))
    assert alone.taught == {"meta": (0, 0), "text": (0, 0)} and taught.taught["meta"] == (300, 300)
    gap = lambda m: np.diff(m.meta.raw(quality.metadata_features(np.array([6, 5]))))[0]
    assert abs(gap(alone)) < 0.2 and gap(taught) > 1


def test_distributed_sums(spark):
    """Newton sums over partitions are those of all rows at once."""
    r = np.random.default_rng(5)
    dense, bits, meta = r.normal(size=(90, len(quality.DENSE))), r.integers(0, 2, (90, 11)), r.integers(0, 4, 90)
    rows = [(dense[i].tobytes(), np.packbits(bits[i].astype(bool)).tobytes(), int(meta[i])) for i in range(90)]
    loose = quality.Unlabelled(spark.createDataFrame(rows, "dense binary, bits binary, meta int").repartition(5), 11)
    mean, scale, w = r.normal(size=20), r.uniform(1, 2, 20), r.normal(size=21)
    bend, slope = loose.sums({1: (1.0, 0.5), 3: (0.0, 0.25)})(mean, scale)(w)
    some = np.isin(meta, [1, 3])
    x = np.hstack([(np.hstack([dense, bits])[some] - mean) / scale, np.ones((some.sum(), 1))])
    want = quality.newton_sums(x, (meta[some] == 1).astype(float), np.where(meta[some] == 1, 0.5, 0.25), w)
    assert np.allclose(bend, want[0]) and np.allclose(slope, want[1])


def test_driver_gives_native_memory_back(spark, monkeypatch):
    """release() asks the JVM to, and goes on where it cannot."""
    from lodestone.llm import scratch

    asked, trim = [], scratch.trim
    monkeypatch.setattr(scratch, "trim", lambda s: asked.append(trim(s)))
    scratch.Scratch(spark, "trimmed").release()
    assert len(asked) == 1 and (asked[0] is None or "Trim native heap" in str(asked[0]) or "not available" in str(asked[0]).lower())
