"""Literal cases and properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import spans as S
from lodestone.functions import text as T
from lodestone.operators import curation, entities, grouping, quality, retrieval, rules, serving
from lodestone.operators import weak_labels as L

SPAN = "array<struct<start:int,end:int,label:string,text:string,confidence:double,source:string>>"


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(column.alias("x")).first().x


def test_normalize(spark):
    for raw, want in [("ＡＢ１２", "ab12"), ("a　b", "a b"), ("a​b", "a b"), ("İ", "İ"), ("ПРИВЕТ", "ПРИВЕТ")]:
        assert one(spark, T.normalize(F.col("t")), t=raw) == want
        assert len(raw) == len(want)


def test_clean_control(spark):
    text, n = T.clean_control(F.col("t"))
    assert one(spark, F.struct(text, n), t="\t兄弟\r\n标签机\t")[:] == ("兄弟  标签机", 4)


def test_template_key(spark):
    a, b, c = (one(spark, T.template_key(F.col("t")), t=x) for x in ("公牛插座3米", "公牛插座5米", "华为手机"))
    assert a == b != c


def test_price(spark):
    assert one(spark, T.price_fen(F.col("p")), p=12.345) == 1235


@pytest.mark.parametrize("text,spans,want", [("学生华为手机256G", [(0, 2), (2, 4), (4, 6)], "256G"), ("abc", [(-10, 1), None, (2, 100)], "b"), ("  untouched  ", None, "untouched"), ("abcd", [(1, 3), (2, 4)], "a")])
def test_residual(spark, text, spans, want):
    frame = spark.createDataFrame([(text, spans)], "t string, s array<struct<start:int,end:int>>")
    assert frame.select(S.residual(F.col("t"), F.col("s")).alias("x")).first().x == want


def test_dictionary(spark):
    d = entities.dictionary(spark.createDataFrame([("苹果", "BRAND", 0), ("苹果15", "SERIES", 100), ("Pro", "MODEL", 0)], "term string, label string, priority int"))
    texts = spark.createDataFrame([(1, "苹果15手机"), (2, "pro手机"), (3, "iPro手机"), (4, "")], "id long, text string")
    got = {r.id: [(e.start, e.end, e.label) for e in r.entities] for r in entities.recognise(texts, d, 6).collect()}
    assert got == {1: [(0, 4, "SERIES")], 2: [(0, 3, "MODEL")], 3: [], 4: []}


def test_hybrid(spark):
    frame = spark.createDataFrame([([(0, 2, "SCENE"), (2, 3, "CATEGORY")], [(0, 3, "CATEGORY")]), ([(0, 3, "BRAND")], [(0, 4, "CATEGORY")])], "m array<struct<start:int,end:int,label:string>>, d array<struct<start:int,end:int,label:string>>")
    got = [[tuple(x) for x in r.x] for r in frame.select(entities.merge_hybrid(F.col("m"), F.col("d")).alias("x")).collect()]
    assert got == [[(0, 3, "CATEGORY")], [(0, 3, "BRAND")]]


def test_fusion(spark):
    frame = spark.createDataFrame([([(0, 2, "BRAND", "x", 0.5, "model")], [(0, 2, "BRAND", "x", 0.9, "dictionary")], []), ([(0, 2, "MODEL", "x", 0.99, "model")], [], [(0, 2, "SPEC", "x", 1.0, "rule")])], f"m {SPAN}, d {SPAN}, r {SPAN}")
    got = [[(x.label, x.source) for x in r.x] for r in frame.select(entities.fuse(F.col("m"), F.col("d"), F.col("r")).alias("x")).collect()]
    assert got == [[("BRAND", "dictionary")], [("SPEC", "rule")]]


@pytest.mark.parametrize(
    "text,want",
    [("500ml", "CAPACITY"), ("10英寸", "SIZE"), ("8x250mm", "SIZE"), ("41码", "SIZE"), ("1kg", "WEIGHT"), ("5公斤", "WEIGHT"), ("220V", "SPEC"), ("5号", "SPEC"), ("2700K", "SPEC"), ("2只", "PACKAGE_COMBINATION"), ("1000条", "PACKAGE_COMBINATION"), ("512G", "CAPACITY"), ("500g", "WEIGHT"), ("14Gx2.0mm", "SIZE"), ("220-240V", "SPEC"), ("105-127mm", "SIZE"), ("0-100mg/L", "SPEC"), ("12GB+512GB", "CAPACITY")],
)
def test_measures(text, want):
    assert entities.measures(text) == [(0, len(text), want)]


def test_measure_guards():
    assert entities.measures("6口味") == []
    assert all("81MM" != "2EDG3.81MM"[s:e] for s, e, _ in entities.measures("2EDG3.81MM"))
    assert all("256GB"[s:e] != "256G" for s, e, _ in entities.measures("256GB"))
    assert entities.measures("180dpiｘ360dpi") == [(0, 13, "SPEC")]
    assert entities.measures("净重 2.5 kg/箱") == [] and entities.measures("a12mm") == []
    assert entities.measures("3 × 4 × 5 cm 8+256G 1-2-3只") == [(0, 12, "SIZE"), (13, 19, "CAPACITY"), (22, 26, "PACKAGE_COMBINATION")]


def test_annotate_measures(spark):
    rows = spark.createDataFrame([(1, "500ml 装"), (2, None), (3, "500ml 装"), (4, ""), (3, "2只 1kg")], "id long, text string")
    got = sorted(tuple(r) for r in entities.annotate_measures(rows).collect())
    assert got == [(1, 0, 5, "CAPACITY", "500ml"), (3, 0, 2, "PACKAGE_COMBINATION", "2只"), (3, 0, 5, "CAPACITY", "500ml"), (3, 3, 6, "WEIGHT", "1kg")]


def test_viterbi_query(spark):
    """Every order at its full length against a plain search."""
    from lodestone.plans.entities import VITERBI_SCORES, viterbi

    sf = "/root/testdata/sf0.001"
    lines: dict = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity").collect():
        lines.setdefault(r.l_orderkey, []).append((r.l_linenumber, r.l_quantity % 7, r.l_quantity % 5))
    move, first, last = VITERBI_SCORES
    got = {r.l_orderkey: r.path for r in viterbi(spark, sf).collect()}
    assert got.keys() == lines.keys()
    for key, rows in lines.items():
        paths = {(t,): first[t] + float(e) for t, e in enumerate(sorted(rows)[0][1:])}
        for row in sorted(rows)[1:]:
            best = {}
            for j in (0, 1):  # of equal paths the one with the lower tag before
                best[j] = max(((s + move[p[-1]][j] + float(row[1 + j]), -p[-1], p) for p, s in paths.items()), key=lambda x: x[:2])
            paths = {best[j][2] + (j,): best[j][0] for j in (0, 1)}
        want = max(((s + last[p[-1]], -p[-1], p) for p, s in paths.items()), key=lambda x: x[:2])[2]
        assert got[key] == "".join(map(str, want))


def test_dup_groups_query(spark):
    """All parts against union-find."""
    from lodestone.plans.curation import dup_groups

    sf = "/root/testdata/sf0.001"
    parts = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_brand", "p_name", "p_type", "p_size").collect()
    up = {p.p_partkey: p.p_partkey for p in parts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    seen: dict = {}
    for p in parts:
        for key in ((p.p_brand, p.p_name), (p.p_name, p.p_type, p.p_size)):
            a, b = root(seen.setdefault(key, p.p_partkey)), root(p.p_partkey)
            up[max(a, b)] = min(a, b)
    got = {r.id: r.grp for r in dup_groups(spark, sf).collect()}
    assert got == {k: root(k) for k in up} and any(p.p_size in range(6, 26) and got[p.p_partkey] != p.p_partkey for p in parts)


def test_structured(spark):
    rows = spark.createDataFrame([(1, "宾得宝（Bundaberg）果汁饮料", ["宾得宝", "Bundaberg"], ["果汁饮料", "饮料", "食品"])], "id long, text string, brands array<string>, categories array<string>")
    got = [(e.label, e.text) for e in L.structured(rows).first().entities]
    assert got == [("BRAND", "宾得宝"), ("BRAND", "Bundaberg"), ("CATEGORY", "果汁饮料")]


def test_normalise_entities(spark):
    aliases = spark.createDataFrame([("SERIES", "苹果15", "iPhone 15", "iphone_15", "product_series_id")], "label string, alias string, canonical string, business_id string, id_type string")
    rows = spark.createDataFrame([(1, "SERIES", "苹果15"), (2, "SPEC", "3.5匹"), (3, "BRAND", "苹果")], "id long, label string, text string")
    got = {r.id: (r.normalized_text, r.normalized_id, r.normalized_type) for r in entities.normalise_entities(rows, aliases).collect()}
    assert got == {1: ("iPhone 15", "iphone_15", "product_series_id"), 2: ("3.5 HP", None, "standardized_power"), 3: (None, None, None)}


@pytest.mark.parametrize("trans,emit,first,last,want", [([[10, 0], [0, 10]], [[5.0, 0.0], [0.0, 4.0]], [0, 0], [0, 0], [0, 0]), ([[0, 0], [0, 0]], [[2.0, 2.0], [2.0, 2.0]], [0, 8], [7, 0], [1, 0])])
def test_viterbi(spark, trans, emit, first, last, want):
    frame = spark.createDataFrame([(emit,)], "e array<array<double>>")
    assert frame.select(S.viterbi(F.col("e"), trans, first, last).alias("x")).first().x == want


def test_crf_marginals():
    import itertools
    import math

    e, t, a, b = [[0.3, 1.0], [0.2, -0.5], [0.9, 0.1]], [[0.5, -0.2], [0.1, 0.4]], [0.1, 0.0], [0.0, 0.3]
    weight = {p: math.exp(a[p[0]] + sum(e[i][p[i]] for i in range(3)) + sum(t[p[i]][p[i + 1]] for i in range(2)) + b[p[2]]) for p in itertools.product(range(2), repeat=3)}
    z = sum(weight.values())
    for i, row in enumerate(quality.crf_marginals(e, t, a, b)):
        for j in range(2):
            assert row[j] == pytest.approx(sum(w for p, w in weight.items() if p[i] == j) / z)


@pytest.mark.parametrize("tags,strict,want", [(["B-X", "I-X", "O", "I-X"], False, [(0, 2, "X"), (3, 4, "X")]), (["B-X", "I-X", "O", "I-X"], True, [(0, 2, "X")]), (["S-A", "B-B", "E-B"], False, [(0, 1, "A"), (1, 3, "B")]), (["I-A", "I-B"], False, [(0, 1, "A"), (1, 2, "B")]), ([], False, [])])
def test_bio(spark, tags, strict, want):
    frame = spark.createDataFrame([(tags,)], "t array<string>")
    assert [tuple(x) for x in frame.select(S.bio_decode(F.col("t"), strict).alias("x")).first().x] == want


def test_spu_dedup(spark):
    rows = [(1, 1, "sku1", "A", 1.0), (1, 2, "sku2", "B", 5.0), (1, 3, "sku3", "A", 9.0), (2, 1, "x", None, 1.0), (2, 2, "y", "", 1.0), (2, 3, "z", "A", 1.0)]
    out = retrieval.dedup_spu(spark.createDataFrame(rows, "q int, rank int, sku_id string, spu_id string, score double")).orderBy("q", "rank").collect()
    assert [(r.q, r.sku_id) for r in out] == [(1, "sku3"), (1, "sku2"), (2, "x"), (2, "y"), (2, "z")]


def test_cache_key(spark):
    v = {"index": "index-v1", "dict": "dict-v2", "ner": "ner-v3", "rule": "rule-v4"}
    keys = [one(spark, serving.cache_key(v, F.lit("q"), F.array(*map(F.lit, f)), F.lit(1))) for f in (["sort=A", "pageSize=20"], ["pageSize=20", "sort=A"], ["sort=B", "pageSize=20"])]
    assert keys[0] == keys[1] != keys[2]
    assert keys[0].startswith("search:result:index-v1:dict-v2:ner-v3:rule-v4:") and keys[0].endswith(":1")


def test_exclusions(spark):
    rows = entities.exclusion_terms(spark, ["手机", "手机壳", "瑜伽垫", "雨伞"], ["壳", "膜", "充电器"], {"手机": [], "瑜伽垫": ["瑜伽垫包", "瑜伽垫带"]}, {}, ("包", "垫")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.position):
        got.setdefault(r.category, []).append(r.term)
    assert got == {"手机": ["手机壳", "手机膜", "手机充电器"], "瑜伽垫": ["瑜伽垫包", "瑜伽垫带"]}


def test_phrase_needs_the_same_analyzer(spark):
    products = spark.createDataFrame([("1", "新款手机壳"), ("2", "手机")], "sku_id string, title string")
    clause = spark.createDataFrame([(1, 1, "title", "手机壳", 1.0)], "q long, clause int, field string, text string, boost double")
    fine = retrieval.build_index(products, {"title": F.col("title")})
    assert [r.doc for r in retrieval.phrase_scores(fine, clause).collect()] == ["1"]
    assert retrieval.phrase_scores(fine, clause, "coarse").count() == 0


def test_aliases(spark):
    assert one(spark, curation.split_aliases(F.col("t")), t='["华为", "HUAWEI"]') == ["华为", "HUAWEI"]
    assert one(spark, curation.split_aliases(F.col("t")), t="华为，HUAWEI|荣耀") == ["华为", "HUAWEI", "荣耀"]


def test_groups_and_split(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"name {i // 3}") for i in range(90)], "id long, text string")
    edges = grouping.key_edges(rows, "id", F.col("text"))
    groups = grouping.components(spark, rows.select("id"), edges, str(tmp_path))
    assert {r.id: r.grp for r in groups.collect()} == {i: i // 3 * 3 for i in range(90)}
    placed = groups.join(grouping.split_groups(groups, {"train": 0.6, "validation": 0.2, "test": 0.2}).select("grp", "split"), "grp")
    assert placed.count() == 90 and grouping.leaks(placed).count() == 0
    assert {r.split for r in placed.select("split").distinct().collect()} == {"train", "validation", "test"}


def test_metrics(spark):
    schema = "id long, start int, end int, label string"
    gold = spark.createDataFrame([(1, 0, 2, "BRAND"), (2, 0, 2, "BRAND"), (3, 0, 2, "BRAND")], schema)
    pred = spark.createDataFrame([(1, 0, 3, "BRAND"), (2, 0, 2, "CATEGORY")], schema)
    assert sorted((r.id, r.kind) for r in quality.error_kinds(gold, pred).collect()) == [(1, "boundary"), (2, "type"), (3, "missing")]
    assert {(r.gold, r.pred): r.n for r in quality.confusion(gold, pred).collect()}["BRAND", "CATEGORY"] == 1
    assert next(r for r in quality.scores(quality.outcomes(gold, pred)).collect() if r.label == "micro").f1 == 0


def test_answers(spark):
    for raw in ('[{"text": "a", "label": "B"}]', '{"entities": [{"text": "a", "label": "B"}]}', '```json\n[{"text": "a", "label": "B"}]\n```'):
        assert [tuple(x) for x in one(spark, L.parse_answer(F.col("t")), t=raw)] == [("a", "B")]


spans = st.lists(st.tuples(st.integers(0, 20), st.integers(1, 6), st.integers(0, 3)), max_size=7)


@settings(max_examples=15, deadline=None)
@given(spans)
def test_resolve_never_overlaps(spark, drawn):
    kind = "struct<start:int,end:int,priority:int>"
    frame = spark.createDataFrame([([(s, s + n, p) for s, n, p in drawn],)], f"x array<{kind}>")
    kept = frame.select(S.resolve_overlaps(F.col("x"), kind, lambda x: [-x["priority"], x["start"] - x["end"], x["start"]]).alias("y")).first().y
    assert all(a.end <= b.start for a, b in zip(kept, kept[1:], strict=False))
    assert bool(kept) == bool(drawn)


def test_streaming_sessions(spark, tmp_path):
    from lodestone.streaming import events as E

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    stream = E.tumbling(E.read(spark, str(tmp_path / "in"), src.schema), late="1000 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("win").collect())) == sorted(map(tuple, E.tumbling(src).collect()))


def test_fill_is_the_greedy_choice():
    import random

    r = random.Random(5)
    for _ in range(300):
        room = {k: r.choice([r.random() * 100, float(r.randint(-5, 60))]) for k in "abc"}
        size, groups = r.randint(1, 9), r.randint(1, 60)
        left, want = dict(room), dict.fromkeys(room, 0)
        for _ in range(groups):
            k = max(left, key=left.get)
            left[k] -= size
            want[k] += 1
        assert grouping._fill(dict(room), size, groups) == want


def test_pack_groups(spark):
    rows = [(g, g % 3 == 0) for g in range(40) for _ in range(1 + g % 7)]
    groups = spark.createDataFrame(rows, "grp long, gold boolean")
    out = grouping.pack_groups(groups, {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()
    total = len(rows)
    sums = {s: sum(r.n for r in out if r.split == s) for s in ("train", "validation", "test")}
    assert len(out) == 40 == len({r.grp for r in out}) and sum(sums.values()) == total
    assert abs(sums["train"] - 0.8 * total) <= 7 and abs(sums["test"] - 0.1 * total) <= 7
    held = {r.grp: r.split for r in grouping.pack_groups(groups, {"train": 0.8, "validation": 0.1, "test": 0.1}, hold_out=True).collect()}
    assert all((g % 3 == 0) == (s != "train") for g, s in held.items())
    assert grouping.pack_groups(groups.limit(0), {"train": 1.0}).count() == 0


def test_sample(spark):
    rows = spark.createDataFrame([(i, "a" if i < 90 else f"s{i}") for i in range(100)], "id long, s string")
    got = curation.sample(rows, "s", F.col("id"), 20).collect()
    assert len(got) == 20 and sum(r.s != "a" for r in got) >= 2
    assert len(curation.sample(rows, "s", F.col("id"), 200).collect()) == 100
    capped = curation.sample(rows, "s", F.col("id"), 50, cap=3).collect()
    assert len(capped) == 13 and sum(r.s == "a" for r in capped) == 3


def test_compact(spark):
    row = curation.compact(spark.createDataFrame([(1, "t", " ", "x", [], [], 5)], "id long, text string, a string, b string, c array<string>, d array<string>, secret int"), ["secret"], ["d"]).first()
    assert (row.id, row.text, row.meta) == ("1", "t", '{"b":"x","d":[]}')


def test_rules(spark):
    texts = spark.createDataFrame([(1, "华为 Mate60 Pro 黑色 512GB"), (2, "USB 2 pcs"), (3, ""), (4, None), (5, "GBH-4UB 5g"), (6, "xiPhone15 不锈钢")], "id long, text string")
    got = {r.id: [(e.text, e.label, e.confidence) for e in r.entities] for r in rules.rules(texts).collect()}
    assert got[1] == [("Mate60 Pro", "MODEL", 0.55), ("黑色", "COLOR", 0.8), ("512GB", "CAPACITY", 0.75)]
    assert got[3] == got[4] == [] and not any(l == "MODEL" for _, l, _ in got[2])
    assert got[5] == [("GBH-4UB", "MODEL", 0.55), ("5g", "WEIGHT", 0.55)]
    assert got[6][-1] == ("不锈钢", "MATERIAL", 0.8)
    assert {e.label for r in rules.rules(texts, ("COLOR",)).collect() for e in r.entities} == {"COLOR"}


def test_listed_overlap(spark):
    got = one(spark, rules.listed(F.col("t"), ("aa",), "COLOR"), t="aaa")
    assert [(x.start, x.end) for x in got] == [(0, 2), (1, 3)]


def test_offline_dictionary(spark):
    entries = spark.createDataFrame([("苹果", "BRAND", 1.0), ("苹果", "CATEGORY", 1.0), ("苹果手机", "CATEGORY", 0.5), ("pro", "MODIFIER", 2.0), ("a", "COLOR", 1.0)], "term string, label string, weight double")
    texts = spark.createDataFrame([(1, "苹果手机Pro"), (2, "iPro 苹果"), (3, "a Pro"), (4, None)], "id long, text string")
    got = {r.id: [(e.text, e.label, e.confidence) for e in r.entities] for r in rules.offline_dictionary(texts, entries, 6, {"COLOR": 2}).collect()}
    assert got == {1: [("苹果手机", "CATEGORY", 0.45), ("Pro", "MODIFIER", 1.0)], 2: [("苹果", "BRAND", 0.9)], 3: [("Pro", "MODIFIER", 1.0)], 4: []}


def test_modes(spark):
    assert [rules.mode_of(m) for m in (None, " Rule ", "MODEL", "odd", "shadow")] == ["hybrid", "dictionary", "model", "hybrid", "shadow"]
    kind = "array<struct<start:int,end:int,label:string>>"
    frame = spark.createDataFrame([([(0, 1, "BRAND")], [(1, 2, "COLOR")]), (None, [(1, 2, "COLOR")])], f"m {kind}, d {kind}")
    for mode, ready, want in [("model", True, ["BRAND", "COLOR"]), ("shadow", True, ["COLOR", "COLOR"]), ("hybrid", True, ["BRAND,COLOR", "COLOR"]), ("hybrid", False, ["COLOR", "COLOR"])]:
        got = [",".join(e.label for e in r.x) for r in frame.select(rules.by_mode(mode, F.col("m"), F.col("d"), ready).alias("x")).collect()]
        assert got == want
    assert one(spark, rules.first_verbatim(F.col("t"), F.array(F.lit(""), F.lit("Sony"), F.lit("索尼"))), t="索尼SONY电视") == "Sony"


def test_request_clauses(spark):
    kind = "array<struct<label:string,text:string,normalized_id:string,normalized_type:string>>"
    rows = spark.createDataFrame(
        [(1, "华为手机", "", [("BRAND", "华为", "7", "brand"), ("CATEGORY", "手机", None, None)], ["电话"]), (2, "耳机", "", [], []), (3, "x", "", None, None)], f"q long, query string, residual string, entities {kind}, synonyms array<string>"
    )
    banned = spark.createDataFrame([("手机", 0, "手机壳"), ("手机", 1, "手机膜"), ("电视", 0, "电视架")], "category string, position int, term string")
    got = entities.request_clauses(spark, rows, banned, {"brand": "brand_id"}).collect()
    of = lambda q: sorted((r.occur, r.kind, r.field, r.text, r.boost) for r in got if r.q == q)
    assert of(2) == [("must", "match", "title", "耳机", 1.0)] and of(3) == [("must", "match", "title", "x", 1.0)]
    assert [x for x in of(1) if x[0] == "must_not"] == [("must_not", "phrase", "title", "手机壳", 1.0), ("must_not", "phrase", "title", "手机膜", 1.0)]
    assert ("should", "term", "brand_id", "7", 60.0) in of(1) and ("should", "match", "title", "电话", 0.5) in of(1)
    assert len(of(1)) == 8 and {r.msm for r in got if r.q == 1} == {1} and len({(r.q, r.clause) for r in got}) == len(got)


def test_merge_adjudicated(spark):
    kind = "id long, text string, spans array<struct<start:int,end:int,label:string>>"
    a, b = [(0, 1, "A")], [(0, 1, "B")]
    rows = spark.createDataFrame([(1, "x", a), (2, "x", a), (2, "x", a), (3, "x", a), (3, "x", b), (4, "x", a), (4, "x", b), (5, "x", a), (5, "x", b)], kind)
    told = spark.createDataFrame([(3, "x", b), (2, "x", a), (5, "other", b), (9, "x", a)], kind)
    got = {r.id: (r.status, r.error) for r in quality.merge_adjudicated(rows, told).collect()}
    assert got == {1: ("silver_single", None), 2: ("gold_agreement", "UNUSED"), 3: ("gold_adjudicated", None), 4: ("gold_adjudicated", "MISSING"), 5: ("gold_adjudicated", "TEXT_MISMATCH"), 9: (None, "UNUSED")}


def test_checks_of_tables(spark):
    l, r = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "no int, id string"), spark.createDataFrame([(0, "a"), (1, "x")], "no int, id string")
    assert sorted((x.no, x.fault) for x in quality.aligned(l, r).collect()) == [(1, "ID_MISMATCH"), (2, "RIGHT_SHORTER")]
    keys = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "k string")
    assert {(x.key, x.n) for x in quality.key_faults(keys, "k").collect()} == {("a", 2), (None, 1)}
    stats = spark.createDataFrame([(100, 5, 0, 0), (100, 6, 0, 0), (100, 0, 0, 1), (0, 0, 0, 0)], "asked long, missed long, unparsed long, unanswered long")
    assert [x.passed for x in quality.gate(stats).collect()] == [True, False, False, True]
    spans = spark.createDataFrame([(1, 0, 2, "A", "rule", False), (1, 0, 2, "A", "llm", True), (1, 0, 2, "B", "llm", None)], "id long, start int, end int, label string, source string, locked boolean")
    assert sorted((x.label, x.sources, x.locked) for x in quality.merge_candidates(spans).collect()) == [("A", ["llm", "rule"], True), ("B", ["llm"], False)]


def test_analyzed_and_highlight(spark):
    got = one(spark, T.analyzed(F.col("t")), t="Ａb3 手机,12")
    assert [tuple(x) for x in got] == [("ab3", 0, 0, 3, "word"), ("手", 1, 4, 5, "ideograph"), ("机", 2, 5, 6, "ideograph"), ("12", 3, 7, 9, "number")]
    assert one(spark, retrieval.highlight(F.col("t"), F.array(F.lit("手"), F.lit("ab3"))), t="Ａb3 手机!") == "<em>Ａb3</em> <em>手</em>机!"
    assert one(spark, retrieval.highlight(F.col("t"), F.array(F.lit("x"))), t="") == "" and one(spark, T.analyzed(F.col("t")), t="") == []


def test_items_and_pages(spark):
    rows = spark.createDataFrame([("", "d1", 1.005, "TRUE "), ("s", "d2", None, "yes"), (None, "d3", 2.0, None)], "sku_id string, doc string, price double, in_stock string")
    assert [(r.sku_id, r.price_fen, r.in_stock) for r in retrieval.item(rows, "doc").collect()] == [("d1", 100, True), ("s", 0, False), ("d3", 200, False)]
    for page, pages, want in [(1, 3, [1, 2, 3]), (1, 9, [1, 2, 3, 4, 5]), (5, 9, [3, 4, 5, 6, 7]), (9, 9, [5, 6, 7, 8, 9]), (1, 0, [])]:
        assert one(spark, retrieval.page_numbers(F.col("p"), F.col("n")), p=page, n=pages) == want


def test_stored_index_and_trace(spark, tmp_path):
    rows = spark.createDataFrame([(1, "red ring", "x"), (2, "blue ring ring", "red")], "sku_id long, title string, tags string")
    made = retrieval.build_index(rows, {"title": F.col("title"), "tags": F.col("tags")})
    retrieval.save_index(made, str(tmp_path / "i"))
    stored = retrieval.load_index(spark, str(tmp_path / "i"))
    clauses = spark.createDataFrame([(1, 1, 0, "must", "match", "title", "ring", 2.0, None), (2, 1, 0, "must", "match", "title", "none", 1.0, None)], "q long, clause int, grp int, occur string, kind string, field string, text string, boost double, msm int")
    a, b = (sorted((r.q, r.doc, round(r.score, 9)) for r in retrieval.match_scores(i, clauses).collect()) for i in (made, stored))
    assert a == b and len(a) == 2
    asked = spark.createDataFrame([(1, "Ring", "ring", [], []), (2, "none", "none", [], [])], "q long, query string, rewritten string, entities array<struct<label:string,text:string>>, synonyms array<string>")
    got = {r.q: r for r in retrieval.trace(asked, clauses, retrieval.boolean(retrieval.match_scores(stored, clauses), clauses)).collect()}
    assert got[1].total == 2 and len(got[1].best) == 2 and got[1].clauses == ["must match(title=ring)^2.0"] and got[1].terms[0].term == "ring"
    assert got[2].total == 0 and got[2].best == []


def test_search(spark):
    from lodestone.operators import search as X

    rows = [(1, "s1", "red ring", "Acme", "ring", 5.0, 10, 4.0), (2, "s1", "red ring big", "Acme", "ring", 4.0, 0, 4.0), (3, "s2", "ring case", "Acme", "case", 1.0, 99, 5.0), (4, "s3", "blue bolt", "Bolts", "bolt", None, None, None)]
    products = spark.createDataFrame(rows, "sku_id long, spu_id string, title string, brand_name string, category_name string, price double, sales_count long, rating double")
    index = R_index(products)
    known = X.Knowledge(
        entities.dictionary(spark.createDataFrame([("acme", "BRAND", 0), ("ring", "CATEGORY", 0), ("nova", "BRAND", 0)], "term string, label string, priority int")), 6, [("crimson", "red")], [("bolt", ["blue"])],
        exclusions=spark.createDataFrame([("ring", 0, "ring case")], "category string, position int, term string"),
    )
    asked = spark.createDataFrame([(1, "acme ring", None, None, None), (2, "ring", 1, 1, "PRICE_ASC"), (3, "crimson", None, None, None), (4, "nova bolt", None, None, None), (5, " ", None, None, None), (6, "acme ring", 2, 1, "PRICE_DESC")], "q long, query string, page int, page_size int, sort string")
    found = X.search(spark, asked, products, index, known)
    got: dict = {}
    for r in found.page.orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append((r.sku_id, r.highlight))
    assert got == {1: [(1, "red <em>ring</em>")], 2: [(2, "red <em>ring</em> big")], 3: [(1, "<em>red</em> ring")], 4: [(4, "blue <em>bolt</em>")], 6: [(2, "red <em>ring</em> big")]}
    assert {r.q: r.error_code for r in found.requests.collect()}[5] == "QUERY_BLANK"
    assert {(r.q, r.doc) for r in found.hits.collect()} == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (4, 4), (6, 1), (6, 2)}


def R_index(products):
    return retrieval.build_index(products, {c: F.col(c) for c in ("title", "brand_name", "category_name")})


def test_postings_are_never_broadcast(spark):
    """The sums of a compressed table look small to the planner, whatever their rows."""
    products = spark.range(50).select(F.col("id").alias("sku_id"), F.concat(F.lit("red bolt "), F.col("id").cast("string")).alias("title"))
    index = retrieval.build_index(products, {"title": F.col("title")})
    clauses = spark.createDataFrame([(1, 1, "title", "red bolt", 1.0)], "q long, clause int, field string, text string, boost double")
    for scores in (retrieval.match_scores(index, clauses), retrieval.phrase_scores(index, clauses)):
        assert scores.count() == 50
        lines = scores._jdf.queryExecution().sparkPlan().toString().split("\n")
        joins = [x for x in lines if "Join " in x]
        assert sum("SortMergeJoin" in x and "[field" in x and ", term" in x for x in joins) == 2
        assert all(", term" not in x for x in joins if "BroadcastHashJoin" in x)


def test_products_are_never_broadcast(spark, tmp_path):
    """Pruned to a key and a price, a compressed catalogue looks small to the planner, whatever its rows."""
    spark.range(50).select(F.col("id").alias("sku_id"), (F.col("id") * 2.0).alias("price")).write.parquet(str(tmp_path / "products"))
    hits = spark.range(0, 100, 2).select(F.lit(1).cast("long").alias("q"), F.col("id").alias("doc"), F.lit(0.5).alias("score"))
    rows = retrieval.with_products(hits, spark.read.parquet(str(tmp_path / "products")))
    assert {(x.doc, x.price) for x in rows.collect()} == {(i, i * 2.0) for i in range(0, 50, 2)}
    joins = [x for x in rows._jdf.queryExecution().sparkPlan().toString().split("\n") if "Join " in x]
    assert len(joins) == 1 and "SortMergeJoin" in joins[0]


def test_sorted_search_does_not_broadcast_products(spark):
    """The queries sorted by price, whose products are a key and a price; rows and order stay those of the SQL (test_queries)."""
    from lodestone.plans.search import QUERIES

    for name in ("search_sort_price", "search_sort_price_desc", "search_sort_rating", "search_sort_sales", "spu_dedup"):
        plan = QUERIES[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
        assert all("sku_id" not in x for x in plan.split("\n") if "BroadcastHashJoin" in x), name
