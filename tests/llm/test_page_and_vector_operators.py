"""Corpus operators over pages and vectors against plain versions, with the edge cases of each."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofgraph.llm import ann, pages, vector_dedup, warc

PAGES = "page_id long, url string, html string"


def text_of(page, *others):
    return pages.main_text(pages.lines_of(page), *(pages.outline_of(pages.lines_of(x)) for x in others))


def test_article_without_chrome():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="sidebar">
    <header><h2>no</h2></header><nav><ul><li><a href=/a>no</a></ul></nav><div class="cookie-notice">no</div><!-- <p>no</p> -->
    <article class="post"><header><h1>Caf&eacute; &amp;  co&#33;</h1></header><p>One<b> two
    three<br>four<p>Five</p><aside>no</aside><div class="ad">no</div><form><p>no</p></form><ul><li>a</li><li>b</ul>
    <section id=comments><article><p>no</p></article></section><footer>no</footer></article><div class="sidebar">no</div><footer>&copy; no</footer>"""
    assert text_of(page) == "Café & co!\nOne two three four\nFive\na\nb"


def test_page_edges():
    assert [text_of(p) for p in ("", "   ", "<article></article>", "a < b &lt; c", "<p", "<nav>menu<article><p>x</p></article>")] == ["", "", "", "a < b < c", "<p", "x"]
    assert text_of("<article>" + "<p>word</p>" * 20_000 + "</article>").count("\n") == 19_999


def test_differencing_deletes_what_neighbours_share():
    frame = "<div><p>Site name</p><p>{}</p><p>{}</p><p>All rights</p></div>"
    one, two = frame.format("first body with many words of its own", "more of the first text"), frame.format("second body, other words entirely", "and some more text here")
    assert text_of(one, two) == "first body with many words of its own\nmore of the first text"
    assert text_of(one, one) == text_of(one)  # a copy tells nothing apart
    assert text_of(one, one, two) == text_of(one, two)  # so the other page does
    near = frame.format("first body with many words of its own", "an edited ending")
    assert text_of(one, near, two) == text_of(one, two)  # a near-copy shares text that the other page hasn't
    assert text_of("<div>Banner of the whole site</div><p>x</p>", "<div>Banner of the whole site</div><p>yy zz</p>") == "x"
    marked = "<article><p>shared</p><p>own {}</p><p>longer own text {}</p></article>"
    assert text_of(*(marked.format(k, k) for k in range(5))) == "shared\nown 0\nlonger own text 0"  # article text on all
    own, outside = "<article><p>Subscribe to us</p><p>own</p></article>", "<p>Subscribe to us</p><article><p>else {}</p></article>"
    assert text_of(own, *(outside.format(k) for k in range(4))) == "own"
    assert text_of(own, *(outside.format(k) for k in range(2))) == "Subscribe to us\nown"  # may be chance


def test_markup_is_a_prior_by_whole_names_and_one_article():
    inside = '<div class="share-price">12</div><p id="notice-1">n</p><h2 class="menu-title">m</h2><div class="cookieNotice">no</div><p>long text here</p>'
    assert text_of(f"<article>{inside}</article><article>teaser</article>") == "12\nn\nm\nlong text here"
    assert text_of("<main><h1>Title</h1><article><p>body</p></article></main><p>after</p>") == "Title\nbody"
    assert text_of("<main><article>a longer body</article><article>teaser</article></main>") == "a longer body"
    assert text_of("<p>See <a href=x>long reference</a></p>") == "See long reference"
    assert text_of("<nav>menu<p>in menu</nav><p>text") == "text"


def test_copies_next_door_are_one_page(spark):
    frame = "<div><p>Site name</p><p>{} body with many words of its own</p></div>"
    rows = [(k, f"http://a.example/x/{k}", frame.format("one")) for k in range(50)] + [(99, "http://a.example/y", frame.format("three"))]
    found = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert found == {k: "one body with many words of its own" for k in range(50)} | {99: "three body with many words of its own"}


def plain_texts(rows):
    """Every page against all others of its host, by a table of subsequence lengths."""
    hosts = defaultdict(dict)
    for i, url, html in rows:
        host, path = pages.url_key(url)
        if host:
            outline = tuple(pages.outline_of(pages.lines_of(html or "")))
            hosts[host][outline] = min(hosts[host].get(outline, (path, i)), (path, i))

    def shared(own, other):
        n, m = len(own), len(other)
        best = np.zeros((n + 1, m + 1), int)
        for i in range(n):
            for j in range(m):
                best[i + 1, j + 1] = best[i, j] + 1 if own[i] >> 1 == other[j] >> 1 else max(best[i, j + 1], best[i + 1, j])
        out, i, j = set(), n, m
        while i and j:
            if own[i - 1] >> 1 == other[j - 1] >> 1 and best[i, j] == best[i - 1, j - 1] + 1:
                i, j = i - 1, j - 1
                out.add((i, bool(other[j] & 1)))
            elif best[i - 1, j] >= best[i, j - 1]:
                i -= 1
            else:
                j -= 1
        return out
    out = []
    for i, url, html in rows:
        lines, (host, _) = pages.lines_of(html or ""), pages.url_key(url)
        own, gone = tuple(pages.outline_of(lines)), None
        order = sorted((at, o) for o, at in hosts[host].items()) if host else []
        place = next((k for k, (_, o) in enumerate(order) if o == own), None)
        others = [order[place + k][1] if place is not None and 0 <= place + k < len(order) else None for k in (-1, 1, -2, 2)]
        pairs = [shared(own, o) if o is not None else set() for o in others]
        for pair in pairs[:2]:
            if 0 < len(pair) < len(own):
                gone = {x for x, _ in pair} if gone is None else gone & {x for x, _ in pair}
        outside = [{x for x, article in pair if not article} for pair in pairs] if None not in others else [set()]
        gone = {k for k in gone or () if not lines[k].article or all(k in o for o in outside)}
        marked = any(x.article for x in lines)
        text = "\n".join(x.text for k, x in enumerate(lines) if k not in gone and not x.chrome and (x.article or not marked))
        out.append((i, text, len(text)))
    return out


def test_pages_query_matches_plain_alignment(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    rows = [tuple(r) for r in table.collect()]
    frame, draw = "<body><p>{}</p><div>{}</div><p>{}</p><ul><li>home</li><li>about</li></ul></body>", random.Random(3)
    for k in range(120):  # pages without marks, hosts with templates, near-copies
        words = " ".join(draw.choice("abcdefgh") for _ in range(6))
        rows.append((10**6 + k, f"http://h{k % 7}.example/{k // 40}/{k}", frame.format("Site", words if k % 5 else "a copy", "All rights")))
    spark.createDataFrame(rows, PAGES).repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    found = {(r.page_id, r.text, r.n_chars) for r in pages.op1_pages(spark, str(tmp_path)).collect()}
    assert found == set(plain_texts(rows)) and any(t == "a b c d e f" or len(t) == 11 for _, t, _ in found)


def template_pages(count):
    """Hosts with templates, copies, and pages with the same lines of which one has some in an advert."""
    draw, rows = random.Random(8), []
    for k in range(count):
        own = [" ".join(draw.choice("abcdefgh") for _ in range(9)) for _ in range(30)]
        own.insert(draw.randrange(30), "Terms")
        body = "".join(f"<p>{x}</p>" for x in own)
        for kind in ("ad", "x") if k % 9 == 0 else ("x",):
            rows.append((len(rows), f"http://h{k % 4}.example/{k}/{kind}", f"<body><p>Site</p><div class={kind}><p>News &amp; more</p></div>{body}<p>All rights</p></body>"))
    return rows


@pytest.mark.parametrize("broadcast", ["-1", "10MB"])
def test_lines_go_whichever_way_pages_meet_their_losses(spark, tmp_path, broadcast):
    rows = template_pages(90)
    rows += [(7000, None, "<p>Site</p>"), (7001, "http://h1.example/0", None), (7002, "http://h1.example/0", "<p>Site</p><p>x</p>")]
    spark.createDataFrame(rows, PAGES).repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        found = sorted(((r.page_id, r.text, r.n_chars) for r in pages.op1_pages(spark, str(tmp_path)).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == sorted(plain_texts(rows), key=str)
    assert all("Site" not in t and len(t) > 400 for i, t, _ in found if i < 7000)


def test_texts_are_not_shuffled_where_few_pages_lose_lines(spark):
    """Pages without a common line: what their neighbours' outlines take is no reason to shuffle the texts."""
    rows = [(k, f"http://h{k % 4}.example/{k}", "".join(f"<p>{k} and {i}</p>" for i in range(60))) for k in range(400)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        found = pages.extract(spark.createDataFrame(rows, PAGES))
        assert {(r.page_id, r.n_chars) for r in found.collect()} == {(k, sum(len(f"{k} and {i}") + 1 for i in range(60)) - 1) for k, *_ in rows}
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_common_subsequence_is_longest():
    draw = random.Random(1)
    for _ in range(200):
        a, b = ([draw.randrange(5) for _ in range(draw.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        pairs = pages.common_subsequence(a, b)
        found = [a[k] for k, _ in pairs]
        assert len(found) == best[-1][-1] and found == [b[k] for _, k in pairs]
        rest = iter(b)
        assert all(x in rest for x in found)


def test_extract_pairs_within_hosts(spark):
    body = "<div><p>Host line</p><p>Text number {} of its own, quite long</p></div>"
    rows = [(k, f"http://{h}.example/en/{k}", body.format(k)) for k, h in enumerate("aaaabbbc" * 3)] + [(100, None, body.format(100)), (101, "http://a.example/x", None), (102, "::bad::", ""), (103, "http://d.example/1", body.format(1))]
    rows += [rows[0], rows[0]]
    found = pages.extract(spark.createDataFrame(rows, PAGES).withColumns({c: F.lit(1) for c in ("key", "path", "before", "text")})).collect()
    assert len(found) == len(rows)
    for r in found:
        lines = r.text.split("\n")
        assert r.n_chars == len(r.text)
        if r.page_id in (101, 102):
            assert r.text == ""
        elif r.page_id in (100, 103):
            assert lines[0] == "Host line"  # nobody to compare with
        else:
            assert len(lines) == 1
    assert pages.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_arc_versions_and_damage():
    for version in (1, 2):
        data = warc.version_block("x.arc", version, "20200102030405") + warc.arc_record(version, "http://a b/", "20200102030405", "text/html", b"HTTP/1.1 200 OK\r\n\r\nbody\nfiledesc://", "x.arc", 9) + b"\n\n" + warc.arc_record(version, "http://c/", "2020", "text/plain", b"", "x.arc", 9)
        records = list(warc.parse_arc(data))
        assert [f[0] for _, f, _ in records] == ["http://a%20b/", "http://c/"] and records[0][2].endswith(b"body\nfiledesc://")
        made = [warc.convert_record("x.arc", *r) for r in records]
        assert made[0][3] == "2020-01-02T03:04:05Z" and made[0][10] == 16 and made[0][11] == hashlib.sha256(b"body\nfiledesc://").hexdigest()
        assert made == [warc.convert_record("x.arc", *r) for r in records] and made[0][2] != made[1][2]
        with pytest.raises(ValueError):
            list(warc.parse_arc(data[:-8]))


def test_arc_conversion_takes_any_bytes(spark, tmp_path, monkeypatch):
    image, latin = bytes(range(256)) * 40, "Größe é".encode("latin-1") * 30
    blocks = [b"HTTP/1.1 200 OK\r\nX-Note: " + "naïve".encode("latin-1") + b"\r\n\r\n" + latin, image, b"HTTP/1.1 200 OK\r\n\r\n" + b"\0" * (50 << 20), b"HTTP/1.1 200 OK\r\n\r\n" + image]
    rows = [(None, None), ("empty.arc", b"")]
    for version in (1, 2):
        data = warc.version_block("x.arc", version, "20200102030405")
        for k, block in enumerate(blocks):
            data += warc.arc_record(version, f"http://a/\u3000{k}", "20200102030405", "image/png", block, "x.arc", len(data)).replace(b" 0.0.0.0 ", b" 192.0.2.7 ", 1)
        rows.append((f"x{version}.arc", data))
    records = warc.convert_arc(spark.createDataFrame(rows, "archive string, content binary"))
    path = str(tmp_path / "out")
    warc.write_warc(warc.mark_revisits(records), path)
    found = warc.read_warc(spark, path).collect()
    payloads = [warc.split_http(b)[1] for b in blocks]
    assert sorted((r.payload_digest, r.payload_bytes) for r in found) == sorted(2 * [(hashlib.sha256(p).hexdigest(), len(p)) for p in payloads])
    assert {r.ip for r in found} == {"192.0.2.7"} and {r.target for r in found} == {f"http://a/%E3%80%80{k}" for k in range(4)}
    assert {bytes(r.http) for r in found} == {warc.split_http(b)[0] for b in blocks}
    assert sum(r.record_type == "revisit" for r in found) == 5  # of eight records three payloads differ
    import gzip
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "out").glob("part-*"))  # zeros at the end are padding
    assert whole.count(b"WARC/1.1\r\n") == 8
    with pytest.raises(ValueError):
        warc.convert_record("x.arc", 0, ["u", "-", "2020", "t", "200", "0" * 32, "-", "0", "x", "1"], b"x")


def test_warc_query_matches_plain_digests(spark, tmp_path):
    long = "é" * 80
    rows = [(1, "http://a/1", long), (2, "http://a/2", long), (3, None, long), (4, "http://a/3", "short"), (5, "http://a/4", "short"), (6, "u", None), (7, "u", ""), (8, "u", "x\r\n\r\nWARC/1.1\r\n\r\n" * 40), (9, "u", "z" * 300_000), (0, "u", "z" * 300_000)]
    spark.createDataFrame(rows, PAGES).withColumn("payload", F.lit(1)).write.parquet(str(tmp_path / "pages.parquet"))
    found = {r.page_id: r for r in warc.op8_warc(spark, str(tmp_path)).collect()}
    first = {}
    for i, _, html in sorted(rows):
        first.setdefault(html or "", i)
    for i, _, html in rows:
        data, r = (html or "").encode(), found[i]
        target = first[html or ""] if len(data) >= 100 else i
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if target == i else ("revisit", target))
    spark.createDataFrame([], PAGES).write.parquet(str(tmp_path / "none" / "pages.parquet"))
    assert warc.op8_warc(spark, str(tmp_path / "none")).count() == 0


def vectors(seed, n=600, dim=24):
    draw = np.random.default_rng(seed)
    x = draw.standard_normal((n, dim)).astype(np.float32)
    for k in range(0, n // 3):
        x[k] = x[n - 1 - k % 7] + 0.1 * draw.standard_normal(dim).astype(np.float32)
    x[40:70] = x[40]
    return x


BAD = [(9000, None), (9001, [0.0] * 24), (9002, [float("nan")] + [1.0] * 23), (9003, [None] + [1.0] * 23), (9004, [float("inf")] + [1.0] * 23), (9005, [])]


def test_nearest_recall_scores_and_edges(spark):
    x = vectors(1)
    rows = [(int(k), v.tolist()) for k, v in enumerate(x)] + BAD + [(9050, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"rank": F.lit(1), "blocks": F.lit(2)})
    found = defaultdict(list)
    for r in ann.nearest(frame, frame.filter("vec_id % 50 = 0"), block=256).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    d = x.astype(np.float64)
    unit = d / np.sqrt((d * d).sum(1))[:, None]
    hit = total = 0
    for q in range(0, 600, 50):
        score = unit @ unit[q]
        score[q] = -9
        best = np.lexsort((np.arange(600), -score.round(12)))[:5]
        hit, total = hit + len(set(best.tolist()) & {i for i, _ in found[q]}), total + 5
        assert [s for _, s in found[q]] == pytest.approx([score[i] for i, _ in found[q]], abs=1e-12)
        assert found[q] == sorted(found[q], key=lambda p: (-p[1], p[0])) and len(found[q]) == 5
    assert hit / total >= 0.9
    assert set(found) == set(range(0, 600, 50))
    assert ann.nearest(frame.limit(0), frame).count() == 0
    few = ann.nearest(frame.filter("vec_id < 3"), frame.filter("vec_id = 0")).collect()
    assert [r.rank for r in sorted(few, key=lambda r: r.rank)] == [1, 2]
    twice = ann.nearest(frame.filter("vec_id < 3").union(frame.filter("vec_id = 2")), frame.filter("vec_id = 0"), block=2).orderBy("rank").collect()
    assert sorted(r.vec_id for r in twice) == [1, 2, 2]  # repeated rows are candidates each, the query's own never is


def test_clustered_vectors_verify_few_and_skip_cells():
    draw = np.random.default_rng(5)
    centres = draw.standard_normal((300, 48))
    x = centres[draw.integers(0, 300, 6000)] + 0.3 * draw.standard_normal((6000, 48))
    index, unit, hit = ann.Index(x), x / np.sqrt((x * x).sum(1))[:, None], 0
    for q in range(0, 6000, 100):
        place, score = index.nearest(x[q], np.arange(6000) == q, 5)
        plain = unit @ unit[q]
        plain[q] = -9
        hit += len(set(place.tolist()) & set(np.argsort(-plain, kind="stable")[:5].tolist()))
        assert score == pytest.approx(plain[place], abs=1e-12)
    assert hit >= 0.9 * 300 and index.verified < 0.1 * 60 * 6000
    # what a cell's radius rules out holds nothing nearer than the score known
    few = unit[:40]
    owner, away = ann.angles(x, few).argmin(1), ann.angles(x, few).min(1)
    for q in range(0, 6000, 500):
        least = np.sort(unit @ unit[q])[-6]
        for cell in range(40):
            radius = away[owner == cell].max()
            if ann.angles(x[q:q + 1], few)[0, cell] - radius > np.arccos(least) + ann.SLACK:
                assert (unit[owner == cell] @ unit[q]).max() < least


@pytest.mark.parametrize("pairs_of_pivots", [False, True])
def test_vector_components_match_brute_force(spark, monkeypatch, pairs_of_pivots):
    monkeypatch.setattr(vector_dedup, "BLOCK", 64)
    if pairs_of_pivots:
        monkeypatch.setattr(vector_dedup, "MOST_PIVOTS", 100)
        monkeypatch.setattr(vector_dedup, "VECTORS_A_PIVOT", 4)
    x = vectors(2)
    rows = [(int(k), v.tolist(), int(k) % 2 if k % 11 else None) for k, v in enumerate(x)] + [(i, v, 1) for i, v in BAD] + [(9100, [1.0, 0.0], 1), (9101, [2.0, 0.01], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"n": F.lit(1), "rep": F.lit(2), "a": F.lit(3)})
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.vector_components(frame).collect()}
    links, root = defaultdict(int), {r[0]: r[0] for r in rows}
    good = [(i, np.array(v, np.float64), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for p, (i, a, la) in enumerate(good):
        for j, b, lb in good[:p]:
            if la == lb and len(a) == len(b) and (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()) >= 0.93:
                links[i] += 1
                links[j] += 1
                m, n = find(i), find(j)
                root[max(m, n)] = min(m, n)
    plain = {r[0]: (links[r[0]], find(r[0]), find(r[0]) == r[0]) for r in rows}
    assert sum(v[0] for v in found.values()) >= 0.99 * sum(links.values()) and set(found) == set(plain)
    assert np.mean([found[k] == plain[k] for k in plain]) >= 0.99
    assert vector_dedup.vector_components(frame.limit(0)).count() == 0


def test_planted_pairs_are_found(spark):
    """Pairs at cosines just above the threshold among random vectors; repeated vec_ids are rows of their own."""
    draw = np.random.default_rng(3)
    x = draw.standard_normal((3000, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    other = draw.standard_normal((1000, 64))
    other -= (other * x[:1000]).sum(1)[:, None] * x[:1000]
    other /= np.sqrt((other * other).sum(1))[:, None]
    c = draw.uniform(0.931, 0.96, 1000)[:, None]
    rows = [(k, v.tolist(), 1) for k, v in enumerate(np.concatenate((x, c * x[:1000] + np.sqrt(1 - c * c) * other)))]
    rows += [(5000, rows[0][1], 1), (5000, rows[1][1], 1)]
    found = [r for r in vector_dedup.vector_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()]
    linked = {r.vec_id for r in found if r.n_links}
    assert len(linked & (set(range(1000)) | set(range(3000, 4000)))) >= 0.98 * 2000 and not linked & set(range(1000, 3000))
    assert sorted((r.n_links, r.component_id) for r in found if r.vec_id == 5000) == [(2, 0), (2, 1)]


def test_shared_pivots_and_lists():
    draw = np.random.default_rng(4)
    for most in (20, 3000):
        a, b = (np.array([draw.choice(most, 8, replace=False) for _ in range(40)]) for _ in range(2))
        plain = np.array([[len(set(p) & set(q)) for q in b.tolist()] for p in a.tolist()])
        assert (vector_dedup.shared_pivots(a, b) == plain).all()
    a, b = np.array([[5, 1, 9]]), np.array([[9, 5, 2]])
    assert vector_dedup.first_shared(a, b, 1, 100).tolist() == [5] and vector_dedup.first_shared(a, b, 2, 100).tolist() == [509]
