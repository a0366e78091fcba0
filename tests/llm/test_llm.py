"""Operators of the llm subpackage against brute force, and their defined results on odd input."""

import gzip
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, kernels, links, pii, quality, warc
from lodestone.llm.ann import nearest
from lodestone.llm.html_text import extract, main_text
from lodestone.llm.line_dedup import dedup_lines
from lodestone.llm.minhash_dedup import near_duplicates
from lodestone.llm.pieces import Model, decode_documents, encode_documents
from lodestone.llm.queries import MODEL_PATH
from lodestone.llm.scratch import Scratch
from lodestone.llm.url_filter import Rule, judge, judge_by_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ba co di fu ge ha".split() for b in "lo mi nu ra se ti vo".split()]


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def copies(seed=3, n=60):
    """Texts with exact copies, near copies, shared lines, odd texts and repeated rows."""
    r = random.Random(seed)
    texts = ["\n".join(sentence(r, r.randint(5, 30)) for _ in range(r.randint(1, 5))) for _ in range(n)]
    out = list(texts)
    for t in texts[:20]:
        w = t.split(" ")
        w[r.randrange(len(w))] = "changed"
        out += [t, " ".join(w), t + "\n" + texts[-1]]
    out += [None, "", "  ", "one", "one", "One", "x" * 50_000, " ".join(["same"] * 3000), "日本語 テキスト", "\n\n", texts[0].upper()]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(out)]
    return [*rows, rows[0], (None, texts[0], None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(copies(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def components(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def alike(a, b):
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= 80 * (len(a) + len(b) - both)


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, docs, words):
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = {}
    for i, t, *_ in copies():
        if i is not None:
            w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
            sets[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    ids = sorted(sets)
    grp = components(len(ids), [(a, b) for a in ids for b in ids if a < b and alike(sets[a], sets[b])])
    got = near_duplicates(spark, docs.withColumn("id", F.lit("clash")).withColumn("bands", F.lit(1)), words=words).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), grp[r.doc_id], grp[r.doc_id] == r.doc_id)


def test_large_buckets_go_through_blocks(spark, monkeypatch):
    """A family around the threshold: every link that counts is found, by blocks as by pairs."""
    r = random.Random(8)
    base = sentence(r, 60).split(" ")
    rows = []
    for i in range(150):
        w = list(base)
        for k in range(r.randint(0, 6)):
            w[r.randrange(60)] = f"own{i}x{k}"
        rows.append((i, " ".join(w), "en", "s", 1))
    frame = spark.createDataFrame(rows, DOCS)
    sets = [{tuple(t.split()[j : j + 2]) for j in range(59)} for _, t, *_ in rows]
    grp = components(150, [(a, b) for b in range(150) for a in range(b) if alike(sets[a], sets[b])])
    for large in (2, 10_000):
        monkeypatch.setattr(links, "LARGE", large)
        monkeypatch.setattr(links, "BLOCK", 7)
        assert {x.doc_id: x.component_id for x in near_duplicates(spark, frame, words=2).collect()} == dict(enumerate(grp))


def test_line_dedup(spark, docs):
    texts = {}
    for i, t, *_ in copies():
        if i is not None:
            texts[i] = t
    first = {}
    for i, t in texts.items():
        for n, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                first.setdefault(line.strip(" "), (i, n))
    kinds = sorted(first.items(), key=lambda x: x[1])
    sets = [{line[j : j + 5] for j in range(len(line) - 4)} or {line} for line, _ in kinds]
    grp = components(len(kinds), [(a, b) for b in range(len(kinds)) for a in range(b) if alike(sets[a], sets[b])])
    stay = {kinds[g][1] for g in grp}
    got = dedup_lines(spark, docs.withColumn("_doc", F.lit(1)).withColumn("n_lines", F.lit("x"))).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None or r.text is None:
            assert r.n_removed == 0
            continue
        t = texts[r.doc_id]
        want = [line for n, line in enumerate(t.split("\n")) if not line.strip(" ") or (r.doc_id, n) in stay]
        assert r.text == "\n".join(want)
        assert r.n_lines == sum(bool(x.strip(" ")) for x in t.split("\n"))


def test_leaks(spark, docs):
    r = random.Random(5)
    items = [" ".join(f"i{k}w{j}" if j % 3 else r.choice(WORDS) for j in range(n)) for k, n in enumerate((12, 20, 33, 45, 59, 3))]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, " \n"), (92, items[0])], "item_id long, text string")

    def hurt(t, edits):
        w = t.split()
        for _ in range(edits):
            w[r.randrange(len(w))] = "edited"
        return " ".join(w)

    rows = [(100 + i, sentence(r, 40) + " " + t.upper() + "\n" + sentence(r, 30), "en", "s", 1) for i, t in enumerate(items)]
    rows += [(200 + i, sentence(r, 33) + " " + hurt(t, 2) + " " + sentence(r, 50), "en", "s", 1) for i, t in enumerate(items[:5])]
    rows += [(300 + i, hurt(t, len(t.split()) // 2 + 3) + " " + sentence(r, 50), "en", "s", 1) for i, t in enumerate(items[2:5])]
    got = decontaminate.leaks(spark, docs.union(spark.createDataFrame(rows, DOCS)), bench).collect()
    found = {(x.doc_id, x.item_id) for x in got}
    want = {(100 + i, i) for i in range(6)} | {(200 + i, i) for i in range(5)} | {(100, 92), (200, 92)}
    assert found == want
    assert all(x.distance == 0 and x.end_word - x.first_word == x.item_words for x in got if x.doc_id < 200)


def test_edit_distance_is_exact():
    r = random.Random(1)
    for _ in range(400):
        p, t = [r.randrange(4) for _ in range(r.randint(1, 9))], [r.randrange(4) for _ in range(r.randint(0, 14))]
        mask = {w: sum(1 << j for j, x in enumerate(p) if x == w) for w in p}
        for anchored in (False, True):
            row = list(range(len(p) + 1))
            best, end = len(p), 0
            for j, w in enumerate(t, 1):
                new = [j if anchored else 0]
                for i, x in enumerate(p, 1):
                    new.append(min(row[i - 1] + (x != w), row[i] + 1, new[-1] + 1))
                row = new
                if row[-1] < best:
                    best, end = row[-1], j
            assert decontaminate.nearest(mask, len(p), t, anchored) == (best, end)


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><div class="content"><article><header><h1>Head &amp; line</h1></header><p><b>First   para&nbsp;graph with enough words to stand.<br><p>Short.</p>
<div class="ad">Buy now, buy a lot of things, this is a long advert.</div><ul><li>Item one</li><li>Item two</li></ul><form><label>Mail</label><input></form><!-- note --></article>
<aside>Related things</aside><section id="comments"><p>I think this comment is long enough to look like text of the article.</p></section></div><footer>&copy; site</footer></body></html>"""


def test_html():
    assert main_text(PAGE) == "Head & line\n\nFirst para graph with enough words to stand.\n\nShort.\n\nItem one\n\nItem two"
    assert main_text("<div id=menu>a</div><div><p>" + "words and more words " * 9 + "</p><p>tail</p></div>").endswith("\n\ntail")
    assert [main_text(x) for x in (None, "", "<p>", "<nav>x</nav>", "plain text", "<p>a &am")] == ["", "", "", "", "plain text", "a &am"]
    assert main_text("<div>" * 20_000 + "deep" + "</p>" * 1000) == "deep"


def test_html_frame(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "u", "<p>é</p>"), (1, "u", PAGE)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 1), (1, len(main_text(PAGE))), (1, len(main_text(PAGE))), (2, 0)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc(spark, tmp_path):
    rows = [(5, "http://a", "<p>é"), (3, "http://b\r\nX: y", "<p>é"), (9, None, None), (4, "u", ""), (7, "u", "z" * 300_000), (3, "http://b", "<p>é"), (None, "u", "<p>é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/out"
    made = warc.write_archives(spark, pages, folder, archive_bytes=1000)
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(made).collect()}
    d = {t: warc.digest(t.encode()) for t in ("<p>é", "", "z" * 300_000)}
    assert got == {(5, 5, d["<p>é"], "revisit", 3), (3, 5, d["<p>é"], "response", None), (None, 5, d["<p>é"], "revisit", 3), (4, 0, d[""], "response", None), (9, 0, d[""], "revisit", 4), (7, 300_000, d["z" * 300_000], "response", None)}
    assert made.agg(F.sum("records")).first()[0] == 7
    for r in made.collect():
        raw = open(r.archive.removeprefix("file://"), "rb").read()
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\n")
    big = {r.record_type for r in warc.read_archives(warc.write_archives(spark, pages, f"file://{tmp_path}/big", min_bytes=10)).collect()}
    assert big == {"response"}
    assert warc.read_archives(warc.write_archives(spark, pages.limit(0), f"file://{tmp_path}/none")).count() == 0


def test_warc_broken(tmp_path):
    whole = gzip.compress(warc.record(1, "u", b"x" * 1000, warc.digest(b"x" * 1000), None, False))
    for raw in (whole[:-30], gzip.compress(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort"), gzip.compress(b"nonsense\r\n\r\n")):
        p = tmp_path / "a.gz"
        p.write_bytes(raw)
        with pytest.raises(ValueError):
            warc.normalise(str(p), str(tmp_path / "b"), str(tmp_path / "c"))


RULES = [Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"), Rule("block", "example.com", "/de/x")]


def test_urls(spark):
    urls = ["http://A.Example.NET/en/1", "https://x.net/", "http://x.net", "http://example.com/de/1?q", "http://example.com/de/xy", "http://notexample.com/de/", "http://b.org/fr/#a", "nonsense", None, "x://", "http://net/en/", "http://example.com:80/de/"]
    frame = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    want = []
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        raw = re.match(r"[^/?#]*", rest).group()
        host, path = raw.lower(), re.match(r"[^?#]*", rest[len(raw) :]).group()
        fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: r.rank, default=None)
        want.append((i, host, path, best and best.name, best.verdict if best else "allow"))
    key = lambda r: r[0]
    assert sorted(map(tuple, judge(frame, RULES).collect()), key=key) == want
    assert sorted(map(tuple, judge_by_join(frame, RULES).collect()), key=key) == want


def test_pii_base():
    def brute(t):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m.group())
            if 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
                out.append(("card", *m.span()))
        return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]

    r = random.Random(2)
    for _ in range(20_000):
        t = "".join(r.choice("ab@@..1234567890 -+()%é") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(t) == brute(t)
    for t in ("1" * 300_000, "a" * 300_000 + "@", "@" * 1000, "+1" + " " * 100_000, "0000000255.1.1.1"):
        pii.base_spans(t)


def test_pii_contexts(spark):
    r = random.Random(4)
    text = lambda i, number: f"{sentence(r, 5)} reach me at desk phone no: {number} before noon {sentence(r, 4)}"
    rows = [(i, text(i, f"+1 (523) 555-{1000 + i}")) for i in range(12)] + [(50, text(50, "555-0199-443")), (51, f"{sentence(r, 5)} order 5550199443 {sentence(r, 3)}"), (52, None), (53, ""), (None, text(0, "555-0199-777"))]
    got = {x.doc_id: x for x in pii.find_pii(spark, spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").withColumn("row", F.lit(1))).collect()}
    assert got[3].n_phone == 1 and got[3].n_added == 0
    assert got[50].n_added == 1 and got[50].n_phone == 0 and got[None].n_added == 1
    kind, s, e = got[50].spans.split(":")
    assert kind == "phone" and rows[12][1][int(s) : int(e)] == "555-0199-443"
    assert got[51].spans == got[52].spans == got[53].spans == ""
    assert got[52].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_pieces(spark, docs):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL_PATH)
    texts = {i: t or "" for i, t, *_ in copies() if i is not None}
    plain = encode_documents(spark, docs, MODEL_PATH, dropout=0.0).collect()
    assert len(plain) == docs.count()
    assert all(r.lossless and r.n_tokens == len(r.token_ids) and list(r.token_ids) == sp.encode(texts[r.doc_id]) for r in plain if r.doc_id is not None)
    odd = spark.createDataFrame([(1, "▁ mark ▁"), (2, "🙂 \x00 \t  two"), (3, "a" * 3000), (4, None), (5, " "), (6, "日本" * 200)], "doc_id long, text string")
    for seed in (1, 2):
        got = encode_documents(spark, odd, MODEL_PATH, dropout=0.3, seed=seed)
        assert all(r.lossless for r in got.collect())
        back = {r.doc_id: r.text for r in decode_documents(spark, got, MODEL_PATH).collect()}
        assert back == {r.doc_id: r.text or "" for r in odd.collect()}
    a, b, c = (sorted(tuple(r.token_ids) for r in encode_documents(spark, docs, MODEL_PATH, dropout=0.2, seed=s).collect()) for s in (1, 1, 2))
    assert a == b != c


def test_heap_and_rows_agree():
    with open(MODEL_PATH, "rb") as f:
        m = Model(f.read())
    r = random.Random(6)
    for _ in range(300):
        symbols = m.char_symbol[[32, *(ord(r.choice("abcdeth")) for _ in range(r.randint(1, 14)))]]
        key = r.getrandbits(64)
        block = np.concatenate([symbols, [-1] * 2])[:, None].astype(np.int32)
        assert [x for x in m.rows(block, np.array([key], np.uint64), 0.3)[:, 0].tolist() if x >= 0] == m.heap(symbols.tolist(), key, 0.3)


def test_quality(spark, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("doc_id % 3 = 0")
    got = quality.score(spark, docs.union(docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long"))), labels.where("doc_id % 3 <> 0"))
    rows = got.join(held, "doc_id").collect()
    bad = lambda r: r.quality == 0
    assert sum(bad(r) == (r.p_poor >= 0.5) for r in rows) >= 0.95 * len(rows)
    clean = [r for r in rows if r.quality == 1 and r.toxic == 0]
    assert sum(r.kept for r in clean) >= 0.98 * len(clean)
    assert got.count() == docs.count() + 1
    assert quality.score(spark, docs, labels.limit(0)).where("not kept").count() == 0
    assert quality.score(spark, empty, labels).count() == 0


def test_neighbours(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(700, 12)).round(3).astype(np.float32)
    x[300:420] = x[300]  # many equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (920, [0.0] * 12), (940, [float("nan")] + [1.0] * 11), (960, [1.0] * 5), (980, [None] + [1.0] * 11), (None, [1.0] * 12), (20, x[20].tolist())]
    got = nearest(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("q", F.lit(1))).collect()
    y = x.astype(float)
    hit = total = 0
    by = {}
    for g in got:
        by.setdefault(g.query_id, []).append(g)
    assert sorted(by) == list(range(0, 700, 20))
    for q, found in by.items():
        found.sort(key=lambda g: g["rank"])
        s = (y * y[q]).sum(1)
        s[q] = -np.inf
        order = np.lexsort((np.arange(700), -s))[:20]
        assert [g["rank"] for g in found] == list(range(1, 21)) and all(abs(g.score - s[g.vec_id]) < 1e-9 for g in found)
        hit, total = hit + len({g.vec_id for g in found} & set(order.tolist())), total + 20
    assert hit >= 0.97 * total
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert [(g.query_id, g["rank"]) for g in nearest(spark, few).orderBy("rank").collect()] == [(0, 1), (0, 2)]
    assert nearest(spark, few.limit(0)).count() == 0


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert near_duplicates(spark, empty).count() == dedup_lines(spark, empty).count() == pii.find_pii(spark, empty).count() == 0
    assert encode_documents(spark, empty, MODEL_PATH).count() == decontaminate.leaks(spark, empty, bench).count() == 0


def test_components_of_a_chain(spark):
    from lodestone.llm.graph import components as spark_components

    r = random.Random(1)
    names = r.sample(range(1000), 200)
    edges = [(a, b) for a, b in zip(names, names[1:], strict=False)] + [(2000, 2001), (2001, 2000), (5, None), (7000, 7000)]
    got = {x.id: x.component for x in spark_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert {got[n] for n in names} == {min(names)} and got[2001] == got[2000] == 2000 and 7000 not in got


def test_words_and_shingles():
    raw = "Ab  c\td\x0be\u00a0f\n".encode()
    data, off = np.frombuffer(raw * 2, np.uint8), np.array([0, len(raw), 2 * len(raw)])
    h, start, end, wo = kernels.words(data, off)
    assert [raw[s:e].decode() for s, e in zip(start[:4], end[:4], strict=True)] == ["Ab", "c", "d", "e\u00a0f"] and wo.tolist() == [0, 4, 8]
    assert h[:4].tolist() == h[4:].tolist()
    s, so = kernels.shingles(h, wo, 5)
    assert so.tolist() == [0, 1, 2] and s[0] == s[1]
