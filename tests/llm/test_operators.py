"""The operators against brute force, on small tables with odd rows."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest

from encaje.llm import (
    decontamination, html, induced, licenses, minhash, packing, quality, secrets, sharding,
    suffixes, toxicity)
from encaje.llm import queries as llm_queries

SF = "/root/testdata/sf0.001"
WORDS = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lamda my ny xi omikron pi rho "
         "sigma tau ypsilon phi chi psi omega").split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(rng.integers(9)) for i in rng.integers(0, len(WORDS), n))


LONG = prose(1, 9000)
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (6, prose(2, 300)),
       (7, prose(2, 300)), (8, prose(2, 300) + " more"), (9, "é ñ 中文 " * 60), (9, "é ñ 中文 " * 60),
       (10, "x" * 3000), (None, prose(3, 90)), (11, prose(4, 40) + " " + prose(5, 120)),
       (12, prose(6, 30) + " " + prose(5, 120)), (13, "a\nb\na\n\nb")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1.5, 7) for i, t in ODD]
    return spark.createDataFrame(
        rows, "doc_id long, text string, spans string, kept double, n_chars long").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def key(i):
    return -1 if i is None else i


def test_packing(docs, none):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack(docs).collect()
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t in ODD}
    by_doc, by_sequence = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(np.array(part, dtype="<u4").tobytes()) == r.ids_crc32
        by_doc.setdefault(r.doc_id, Counter())[r.start] += r.length
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    copies = Counter(i for i, _ in ODD)
    assert {i: sum(c.values()) for i, c in by_doc.items()} == {
        i: copies[i] * len(x) for i, x in ids.items()}
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(none).count() == 0


def test_patterns_cover_the_demand():
    demand = np.random.default_rng(0).integers(0, 60, 64)
    shape, times = packing.patterns(demand)
    assert ((times @ shape) >= demand).all() and (shape @ np.arange(1, 65) <= 64).all()
    least = (demand * np.arange(1, 65)).sum() / 64
    assert times.sum() <= least * 1.03 + 2


def test_inverse_needs_no_linear_algebra_library():
    rng = np.random.default_rng(1)
    matrix = rng.integers(0, 5, (80, 80)) + 20 * np.eye(80)
    matrix[0, 0] = 0
    assert np.allclose(packing.inverted(matrix) @ matrix, np.eye(80))


def test_patterns_of_a_corpus_end_in_time():
    import time
    demand = np.random.default_rng(2).integers(0, 200, 256)
    began = time.monotonic()
    shape, times = packing.patterns(demand)
    assert ((times @ shape) >= demand).all() and time.monotonic() - began < 60


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(6, 1, 0), (11, 1, 0), (10, 0, 0), (None, 1, None)],
                                   "doc_id long, quality int, toxic int")
    got = {}
    for r in quality.judge(docs, labels).collect():
        got[r.doc_id] = r
    for i, text in ODD:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = Counter(zip(words, words[1:], words[2:]))
        hit = {k for j, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1
               for k in range(j, j + 3)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (
            len(words), sum(map(len, words)), len(hit), len(lines) - len(set(lines)))
        assert r.base_failed == (len(words) < 50 or 100 * len(hit) > 50 * len(words))
        assert not (r.base_failed and r.kept)
    assert got[6].kept and got[11].kept
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {6, 11}
    assert quality.judge(none, labels).count() == 0


def test_anomalies_score_higher():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(400, 5))
    forest = quality.Forest([rng.permutation(rows)[:256] for _ in range(100)], quality.Settings())
    assert forest.score(np.full((1, 5), 8.0))[0] > forest.score(rows).mean() + 0.15


def test_every_passing_row_can_be_drawn_for_every_tree(spark):
    frame = spark.createDataFrame([(i, *[i + k for k in range(9)]) for i in range(3000)],
                                  "doc_id long, " + quality.SCHEMA)
    few = quality.Settings(trees=40, rows_per_tree=32)
    drawn = quality.tree_rows(frame, few)
    assert len(drawn) == 40 and all(len(r) == 32 for r in drawn)
    assert len({tuple(r) for d in drawn for r in d}) > 900  # 40 draws of 32 out of 3,000
    again = quality.tree_rows(frame.repartition(7), few)
    assert all((a == b).all() for a, b in zip(drawn, again))
    assert [len(r) for r in quality.tree_rows(frame.limit(5), few)] == [5] * 40
    assert quality.tree_rows(frame.limit(0), few) == []


def test_quality_catches_labelled_bad_rows(spark):
    rng, rows = np.random.default_rng(9), []
    for i in range(400):
        words = [w + "," * int(rng.random() < rng.choice([0.02, 0.3])) for w in
                 prose(1000 + i, int(rng.choice([60, 100, 400]))).split()]
        if i % 16 == 0:
            words = [w + "***" for w in words]  # junk that passes the base rules
        elif i % 16 == 1:
            words = [w + " |" * (j % 3 == 0) for j, w in enumerate(words)]  # a menu
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 16 > 1), 0) for i in range(200)],
                                   "doc_id long, quality int, toxic int")
    got = quality.judge(frame, labels).collect()
    assert not any(r.base_failed for r in got)
    bad = [r.kept for r in got if r.doc_id % 16 < 2]
    good = [r.kept for r in got if r.doc_id % 16 > 1]
    assert not any(bad) and sum(good) >= 0.98 * len(good)
    assert {r.doc_id for r in quality.keep_good(frame, labels).collect()} == {
        r.doc_id for r in got if r.kept}


def test_toxicity(spark, docs, none):
    rows = [(i, prose(i, 60) + (" vile" * (1 + i % 4) if i % 5 == 0 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 150)],
                                   "doc_id long, quality int, toxic int")
    own = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(own, labels).collect()}
    held_out = [got[i].toxic == (i % 5 == 0) for i in range(150, 200)]
    assert np.mean(held_out) > 0.97
    assert got[3].expected_severity < got[5].expected_severity
    assert not any(r.toxic for r in toxicity.score(docs, labels.limit(0)).collect())
    assert toxicity.score(none, labels).count() == 0


def test_html(spark):
    page = ('<html><head><title>T</title><script>var a="<p>";</script></head><body><nav><a href=x>m'
            '</a></nav><div class="ad">buy</div><article><h1>T{0}</h1><p><b>One &amp;  two{0}<br>'
            '<p>Three, four. Five{0}.</p></article><footer>&copy; x</footer></body></html>')
    rows = [(i, "u", page.format(i)) for i in range(40)] + [
        (98, None, None), (99, "u", " "), (100, "u", "<p>a<div"), (None, "u", page.format(7))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html.main_text(pages).collect()}
    assert got[5].text == "T5\n\nOne & two5\n\nThree, four. Five5."
    assert got[5].n_chars == len(got[5].text)
    assert got[98].text == "" and got[99].text == ""
    assert html.main_text(pages.limit(0)).count() == 0


MAIN = re.compile(r"<(/?)article")


def test_main_text_does_not_hang_on_the_mark(spark):
    """Trees learn from given pages; others of them lose the mark that gave the labels."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = html.fit(pages.where("page_id % 5 < 3"))
    tested = [r.html for r in pages.where("page_id % 5 >= 3").orderBy("page_id").collect()]
    want = html.extract(tested, model)
    for name in ("div", "section", "td"):
        got = html.extract([MAIN.sub(rf"<\1{name}", x) for x in tested], model)
        assert sum(a == b for a, b in zip(got, want)) >= 0.95 * len(tested)
    inside = tested[0].replace("</article>", "<p>Formula <math><mi>x</mi></math> and <canvas>fallback</canvas> "
                               "<noscript>plain text</noscript> end.</p></article>")
    assert html.extract([inside], model)[0].endswith("Formula x and fallback plain text end.")


def test_decoding_is_consistent():
    rng = np.random.default_rng(1)
    tree = html.Tree("<body><div><p>a<b>c</b></p><ul><li>d<li>e</ul></div><form>f</form>")
    parent = [x.parent for x in tree.nodes]
    best = None
    score = rng.normal(size=len(parent))
    kept = html.decode(tree, score)
    for mask in range(2 ** (len(parent) - 1)):
        k = [True] + [bool(mask >> i & 1) for i in range(len(parent) - 1)]
        if all(not k[i] or k[parent[i]] for i in range(1, len(k))):
            total = sum(s if x else -s for s, x in zip(score, k))
            best = max(best, total) if best is not None else total
    assert all(not kept[i] or kept[parent[i]] for i in range(1, len(kept)))
    assert abs(sum(s if x else -s for s, x in zip(score, kept)) - best) < 1e-9


def test_secrets(spark, docs, none):
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(60)]
    rows = [(i, f"some words password={h} internationalisation_of_things {prose(i, 20)}")
            for i, h in enumerate(hexes[:50])]
    rows += [(100, f"plain {hexes[55]} end"), (101, "AKIA" + "B" * 16 + " token: ab12"),
             (102, "see Zq9" + hexes[56][:20].upper() + " here"), (103, None), (104, "")]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.find(own).collect()}
    assert got[0].n_assign == 1 and got[0].n_hex == 1 and got[0].n_access == 0
    assert got[100].spans == "hex:6:46" and got[101].spans.startswith("access:0:20")
    assert got[101].n_assign == 0 and got[103].spans == ""
    assert got[104].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r.text for r in secrets.redact(own).collect()}
    assert clean[100] == "plain [secret] end" and clean[103] is None
    assert "internationalisation" in clean[0]
    out = secrets.redact(docs)
    assert out.columns == docs.columns and out.count() == len(ODD)
    assert secrets.find(none).count() == 0


BASE = [("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
        ("access", r"(AKIA[A-Z0-9]+)", 20), ("hex", r"([0-9a-f]+)", 24)]


def test_secret_patterns_equal_brute_force(spark):
    cases = ["API-KEY=abcdef apikey = 'Zq+/_.=-9' Api_Key:\"xyz123\"", "password=secret=token:abcdef12",
             "token='YWJjZGVmZ2g=' SECRET : hunter22, passwd=abc", "AKIA" + "Z" * 15 + " AKIA" + "9" * 16,
             "AKIAAKIA" + "Q" * 20 + "a", "0" * 23 + "g" + "f" * 24 + "F" + "a1" * 40, "\u00e9\U0001f600 token=" + "ab12" * 8,
             "secret\t=abcdefg secret=  abcdefg token\"  :'abcdef'", "pa\u017fsword=abcdef to\u212aen=abcdef",
             "password=AKIA" + "B" * 16 + "c0ffee" * 5, "x" * 5000 + "token:" + "d" * 5000, "", " \n "]
    cases += [prose(i, 30) + f" Token = {'0a' * i} {prose(i + 1, 5)}" for i in range(30)]
    got = {r.doc_id: r for r in secrets.find(
        spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()}
    for i, text in enumerate(cases):
        spans = []
        for kind, (name, pattern, least) in enumerate(BASE):
            flags = re.ASCII | re.IGNORECASE if name == "assign" else re.ASCII
            spans += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, flags) if len(m[1]) >= least]
        spans.sort()
        line = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), text
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == j for _, k, _ in spans) for j in range(3)]
        assert set(filter(None, line.split(","))) <= set(got[i].spans.split(","))


ORDINARY = """internationalisation_of_things getElementByIdentifierName MAX_CONNECTION_TIMEOUT_SECONDS
XMLHttpRequestFactoryBean org/apache/spark/sql/functions AbstractSingletonProxyFactoryBean customer_address_line_2
user_profile_image_url_https background-position-horizontal static/images/banner/top_left_2020
DEFAULT_BUFFER_SIZE_IN_BYTES convertUtf8StringToBytes isAuthenticatedWithOAuth2 numberOfRetriesBeforeFailure
max_pool2d_with_indices_backward test_parse_iso8601_timestamp application/x-www-form-urlencoded
Donaudampfschifffahrtsgesellschaft anticonstitutionnellement electroencefalografista 2024-01-15T10-20-30
usr/local/share/applications src/main/java/com/example/App node_modules/lodash/fp/convert getUserByEmailAddress2
HttpServletRequestWrapper spark-sql-kafka-0-10_2-12 feature/ABC-1234-add-login-page vgg16_imagenet_weights
convolution_layer_3x3_relu ConcurrentModificationException 4111111111111111 19216801001921680100 20240115102030123456
on_button_clicked_listener --------------------- ==================== ________________ aaaaaaaaaaaaaaaaaaaa LC_MESSAGES_DIRECTORY I18nResourceBundleMessageSource
kubernetes-dashboard-settings parseJSONFromHTTPResponse SELECT_FOR_UPDATE_NOWAIT incomprehensibilities
misunderstandings-about counterrevolutionaries responsabilidades-profesionales ftp/pub/linux/kernel/v5
build-2023-11-05-nightly utf8_general_ci_default col-md-offset-2-col-sm org_springframework_context""".split()


def test_markov_models_find_held_out_strings(spark):
    """Random strings of several alphabets that no pattern knows, and identifiers: none was trained on."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = secrets.fit(docs, secrets.prepare(docs))
    draw = random.Random(5)
    letters = string.ascii_letters + string.digits
    for alphabet in (letters, letters + "+/", string.ascii_lowercase + string.digits, "0123456789ABCDEF"):
        for size in (16, 20, 24, 32, 40):
            hits = sum(model.secret("".join(draw.choices(alphabet, k=size))) for _ in range(300))
            assert hits >= 0.9 * 300, (alphabet, size, hits)
    assert len(ORDINARY) >= 50 and [x for x in ORDINARY if model.secret(x)] == []


def test_a_copied_unknown_secret_is_found(spark):
    """A secret that no pattern knows, in a third of all documents, doesn't teach that it is ordinary."""
    key = "Zr8QmT2xVb5LwK9pYd3H"
    rows = [(i, f"{prose(i, 60)} token: {hashlib.sha1(str(i).encode()).hexdigest()} {key if i % 3 == 0 else ''} "
             f"{ORDINARY[i % len(ORDINARY)]}") for i in range(300)]
    got = secrets.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.n_markov == (r.doc_id % 3 == 0) for r in got)


def test_sharding(docs, none):
    rows = sharding.placement(docs, (1.0, 2.0, 1.0)).collect()
    assert len(rows) == len(ODD)
    assert all(r.grown_shard in (r.shard, 3) for r in rows)
    for s in range(3):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    sizes = {r.doc_id: (r.size, r.text_crc32) for r in rows}
    for i, t in ODD:
        assert sizes[i] == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    many = docs.sparkSession.range(9000).withColumnRenamed("id", "k")
    share = {r.shard: r["count"] for r in sharding.shard(
        many, ["k"], [1.0, 2.0]).groupBy("shard").count().collect()}
    assert abs(share[1] / 9000 - 2 / 3) < 0.03
    assert sharding.placement(none).count() == 0


def test_decontamination(spark, docs, none):
    items = [(1, prose(5, 120)), (2, "one"), (3, None), (4, prose(77, 30)), (5, prose(5, 120))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.contamination(docs, bench).collect()}

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(
            "[A-Z]", lambda m: m[0].lower(), t or ""))

    for i, text in ODD:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(10, len(v))
            windows = {tuple(v[k:k + n]) for k in range(len(v) - n + 1)} if v else set()
            for k in range(len(w) - n + 1) if windows else ():
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add(str(item))
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (
            len(w), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    assert got[11].contaminated and got[4].contaminated
    left = decontamination.remove(docs, bench)
    texts = {r.doc_id: r.text for r in left.collect()}
    assert left.columns == docs.columns and 4 not in texts and texts[1] is None
    assert texts[11].strip() == prose(4, 40) and texts[6] == ODD[5][1]
    assert decontamination.contamination(none, bench).count() == 0
    assert not any(r.contaminated for r in decontamination.contamination(
        docs, bench.limit(0)).collect())


def test_benchmark_blocks_give_the_same(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(i, prose(5, 40 + i)) for i in range(9)],
                                  "item_id long, text string")
    whole = sorted(map(tuple, decontamination.contamination(docs, bench).collect()), key=repr)
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 400)
    parts = sorted(map(tuple, decontamination.contamination(docs, bench).collect()), key=repr)
    assert whole == parts


def test_fm_index():
    text = np.random.default_rng(0).integers(1, 4, 500)
    index = decontamination.FMIndex(text)
    patterns = np.random.default_rng(1).integers(1, 5, (40, 4))
    low, high = index.search(patterns)
    for p, a, b in zip(patterns, low, high):
        want = [i for i in range(497) if (text[i:i + 4] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def brute_components(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(5, len(w))
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if w else set()
    low = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= percent * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    return sets, low


def test_minhash(spark, docs, none):
    base = prose(50, 200).split()
    rows = [(i, t) for i, t in ODD if i is not None]
    for i in range(40):  # a chain of near copies
        base[(7 * i) % 200] = f"new{i}"
        rows.append((100 + i, " ".join(base)))
    sets, low = brute_components(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = minhash.near_duplicates(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (
            len(sets[r.doc_id]), low[r.doc_id], low[r.doc_id] == r.doc_id)
    kept = minhash.keep_one(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and ids.count(9) == 1 and ids.count(None) == 1
    assert {6, 7, 8} & set(ids) == {6}
    assert minhash.near_duplicates(none).count() == 0


def test_near_dedup_stage_links_from_eighty_percent(spark):
    import corpus_pipeline
    words, far = prose(70, 204).split(), prose(70, 204).split()
    far[10], far[60], far[110], far[160] = "w", "x", "y", "z"  # 180 of 220 shingles: 0.818
    other = list(far)
    other[185] = "v"  # 175 of 225 with the first: 0.778
    for rows, stay in (([(1, words), (2, far)], {1}), ([(1, words), (3, other)], {1, 3})):
        frame = spark.createDataFrame([(i, " ".join(w)) for i, w in rows],
                                      "doc_id long, text string")
        kept = corpus_pipeline.near_dedup(spark, frame, SF)
        assert {r.doc_id for r in kept.collect()} == stay
        assert all(r.kept for r in minhash.near_duplicates(frame).collect())


def test_minhash_splits_large_groups(spark, monkeypatch):
    monkeypatch.setattr(minhash, "GROUP", 3)
    monkeypatch.setattr(minhash, "BLOCK", 2)
    base, rows = prose(60, 120).split(), []
    for i in range(30):
        w = list(base)
        for k in range(i % 4):
            w[(11 * i + 29 * k) % 120] = f"x{i}{k}"
        rows.append((i, " ".join(w)))
    _, low = brute_components(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == low


def test_licenses(spark, docs, none):
    rows = [(1, "Intro text\nReleased under the MIT License.\nend"), (2, "Released under the MIT License."),
            (3, "released  under THE mit license"), (4, "Released quickly"), (5, None)]
    got = {r.doc_id: r for r in licenses.scan(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].best for i in (1, 2, 3, 4, 5)] == ["mit", "mit", "mit", None, None]
    assert got[1].dice == 1.0 and got[5].n_matches == 0
    assert licenses.scan(docs).count() == len(ODD) and licenses.scan(none).count() == 0


def brute_licenses(text):
    """Every window and unit against every template, without any pruning."""
    def pairs(t):
        w = re.findall("[a-z0-9]+", t.lower())
        return list(zip(w, w[1:]))

    table = [(n, pairs(t)) for n, t in licenses.TEMPLATES]
    p = pairs(text)
    units = {tuple(dict.fromkeys(pairs(u))) for u in [text, *re.split(r"\n[ \t\r]*\n", text), *text.split("\n")]}
    for _, t in table:
        n = {i: len(set(p[i:i + len(t)]) & set(t)) for i in range(len(p)) if p[i] in t}
        n = {i: k for i, k in n.items() if k >= licenses.fewest_shared(len(set(t)), 0.8)}
        units |= {tuple(dict.fromkeys(p[i:i + len(t)])) for i in n if (n[i], -i) == max(
            (n[j], -j) for j in n if abs(i - j) < len(t))}
    best = [(*max((2 * len(set(u) & set(t)) / (len(u) + len(set(t))), n) for n, t in table), set(u)) for u in units if u]
    best = [b for b in best if b[0] >= 0.8]
    best = [b[:2] for b in best if not any(o[0] > b[0] and o[1] != b[1] and b[2] <= o[2] for o in best)]
    return len(best), ",".join(sorted({n for _, n in best})), *(max(best)[::-1] if best else (None, None))


def test_licenses_in_lines_and_headers(spark):
    by = {}
    for name, t in licenses.STATEMENTS:
        by[name] = t  # the last one
    wrapped = "\n".join(" * " + " ".join(by["gpl-3.0"].split()[i:i + 7]) for i in range(0, 60, 7))
    cases = {
        "mit": "Copyright 2020 X. Released under the MIT License. " + prose(1, 80),
        "gpl-3.0": "/*\n" + wrapped + "\n */\nint main() { return 0; }\n" + prose(2, 60),
        "gpl-2.0": prose(3, 30) + " " + dict(licenses.STATEMENTS)["gpl-2.0"] + " " + prose(4, 30),
        "lgpl-2.1": "// " + by["lgpl-2.1"].replace("Software", "Software\n// "),
        "bsd-3-clause": "3. " + by["bsd-3-clause"] + " " + prose(5, 20),
        "agpl-3.0": "# SPDX-License-Identifier: AGPL-3.0-or-later\nimport os\n" + prose(6, 10),
        "cc0-1.0": prose(7, 9) + " " + by["cc0-1.0"].replace("worldwide", "everywhere"),
        "": prose(8, 300) + " a license to use the software under the terms of the shop " + prose(9, 50)}
    rows = list(enumerate(cases.values())) + [(99, "the license " * 3000), (100, "MIT License. Released under the " * 60)]
    got = {r.doc_id: r for r in licenses.scan(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (name, text) in enumerate(cases.items()):
        assert got[i].licenses == name, (name, got[i])
    for i, text in rows:
        if i != 99:
            assert tuple(got[i])[1:] == pytest.approx(brute_licenses(text)), i
    assert got[99].n_matches == 0



@pytest.mark.parametrize("hot", [suffixes.HOT_SEGMENTS, 1])
def test_suffixes(spark, docs, none, hot):
    length, gram = 60, 25
    got = {}
    for r in suffixes.repeats(docs, length, gram, hot).collect():
        got.setdefault(r.doc_id, []).append(r)
    data = [(i, (t or "").encode()) for i, t in ODD]
    seen = Counter(d[k:k + length] for _, d in data for k in range(len(d) - length + 1))
    for i, d in data:
        mark = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if seen[d[k:k + length]] > 1:
                mark[k:k + length] = b"\1" * length
        kept = bytes(x for x, m in zip(d, mark) if not m)
        for r in got[i]:
            assert (r.n_bytes, r.n_removed) == (len(d), sum(mark))
            assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
            assert r.n_spans == len(re.findall(b"\1+", bytes(mark)))
    assert len(got[9]) == 2 and suffixes.repeats(none).count() == 0


def test_suffixes_finds_planted_passages(spark, tmp_path):
    """Passages of over 50 words, each in two documents: those of 400 bytes leave, shorter ones stay by contract."""
    passages = [prose(100 + i, n) for i, n in enumerate((51, 55, 60, 64, 70, 100, 150))]
    exact = prose(200, 90).encode()
    passages += [exact[:399].decode(), exact[100:500].decode()]
    texts, where = {i: "é " + prose(300 + i, 120) for i in range(40)}, {}
    for i, passage in enumerate(passages):
        for j, at in ((2 * i, 300), (2 * i + 1, 500)):
            head = texts[j][:at] + "AB"[j % 2]  # other bytes on both sides: no more than the passage is shared
            texts[j] = head + passage + "CD"[j % 2] + texts[j][at:]
            where[j] = (len(head.encode()), len((head + passage).encode()))
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3).write.parquet(
        str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in llm_queries.op10_suffixes(spark, str(tmp_path)).collect()}
    data = {i: t.encode() for i, t in texts.items()}
    seen = Counter(d[k:k + 400] for d in data.values() for k in range(len(d) - 399))
    caught = set()
    for i, d in data.items():
        mark = bytearray(len(d))
        for k in range(len(d) - 399):
            if seen[d[k:k + 400]] > 1:
                mark[k:k + 400] = b"\1" * 400
        kept = bytes(x for x, m in zip(d, mark) if not m)
        assert (got[i].n_bytes, got[i].n_removed) == (len(d), sum(mark))
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()
        assert got[i].n_spans == len(re.findall(b"\1+", bytes(mark)))
        if got[i].n_removed:
            caught.add(i)
            assert got[i].spans == "{}:{}".format(*where[i])
    assert caught == {i for i, (a, b) in where.items() if b - a >= 400}
    assert 0 < len(caught) < len(where)


def test_induced_sorting_against_brute_force():
    rng = np.random.default_rng(3)
    for trial in range(60):
        cap, base = int(rng.integers(2, 9)), rng.integers(2, 6, 50)
        parts = []
        for _ in range(6):
            i, j = sorted(rng.integers(0, 51, 2))
            part = base[i:j].tolist()
            if rng.random() < 0.5:
                part.insert(len(part) // 2, 258 + int(rng.integers(3)))
            parts += part + [1]
        text = parts + [0]
        mark = induced.repeated_starts(np.array(text), cap, 64 if trial % 2 else 1 << 20)
        seen = Counter(tuple(text[k:k + cap]) for k in range(len(text) - cap + 1))
        for k in range(len(text) - cap + 1):
            window = tuple(text[k:k + cap])
            if len(set(window)) > 1:
                assert mark[k] == (seen[window] > 1)


def test_pipeline_and_registry(spark):
    import __spark_entry__ as entry
    import corpus_pipeline
    assert len([n for n in entry.queries() if re.match(r"op\d+_", n)]) == 13
    packed = corpus_pipeline.run(spark, SF)
    stages = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = stages
        stages = stage(spark, stages, SF)
        assert stages.columns == before.columns
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in stages.collect()}


def test_one_id_with_two_texts_ties_both(spark):
    a, b = prose(901, 120), prose(902, 120)
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (4, prose(903, 80))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for part in (1, 3):
        got = {(r.doc_id, r.n_shingles): r.component_id
               for r in minhash.near_duplicates(frame.repartition(part)).collect()}
        assert {i for (d, _), i in got.items() if d in (1, 2, 3)} == {1} and got[(4, 76)] == 4
        kept = sorted(tuple(r) for r in minhash.keep_one(frame.repartition(part)).collect())
        assert [r[0] for r in kept] == [1, 4] and kept[0] == min(
            kept[0:1], default=None) and kept[0][1] in (a, b)
        first = kept if part == 1 else first
        assert kept == first


def test_quality_limit_counts_every_labelled_row():
    import pandas as pd

    rng = np.random.default_rng(4)
    good, bad = rng.beta(2, 5, 40_000), rng.beta(5, 2, 30_000)
    at = np.floor(np.concatenate([good, bad]) * quality.SCORE_PLACES).astype(np.int64)
    counted = pd.DataFrame({"place": at, "good": np.repeat([1, 0], [len(good), len(bad)]),
                            "bad": np.repeat([0, 1], [len(good), len(bad)])}).groupby("place", as_index=False).sum()
    every = np.unique(np.concatenate([good, bad]))
    gain = (np.searchsorted(np.sort(good), every, side="right") / len(good)
            - np.searchsorted(np.sort(bad), every, side="right") / len(bad))
    limit = quality.limit_of(counted, quality.Settings())
    assert abs((good <= limit).mean() - (bad <= limit).mean() - gain.max()) < 1e-3
    only_good = counted.assign(bad=0)
    lost = (good > quality.limit_of(only_good, quality.Settings())).mean()
    assert 0 < lost <= 0.002
    assert quality.limit_of(counted.assign(good=0), quality.Settings()) == float("inf")
    assert (np.diff(quality.places(np.sort(good))) >= 0).all()
