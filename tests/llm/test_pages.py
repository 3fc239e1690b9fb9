"""URL filter, WARC bundles and main text of pages."""
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpusflow.llm import html_text, url_filter, warc

PAGES = "page_id long, url string, html string, host string, digest int, verdict int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, 2) for i, u, h in rows], PAGES)


# URL filter

def stated(host, path):
    fits = [(r, v) for r, v in url_filter.RULES for name, at in [r.split("/", 1)]
            if (host == name or host.endswith("." + name)) and path.startswith("/" + at)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


URLS = [None, "", "no scheme", "http://", "http://NET", "http://net/", "https://A.example.NET/en/x?y=/z", "http://example.net/en", "http://a.b.org/fr/1#t",
        "ftp://xorg/fr/", "http://example.com/de/?q", "http://example.com/DE/", "x://a.net?u=http://b.org/fr/", "http://sub.example.com/de/1://net/",
        "http://ünet.net/é", "http://example.net#/en/", "http://a.net/" + "y/" * 20_000, "http://a.net\n/x", " http://net/en/"]


def test_hosts_paths_and_stated_rules(spark):
    out = {r.page_id: r for r in url_filter.judge(pages(spark, [(i, u, None) for i, u in enumerate(URLS)]),
                                                  spark.createDataFrame([], "url string, bad boolean")).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re
    for i, u in enumerate(URLS):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = host.translate(lower)
        rule, verdict = stated(host, path)
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict) == (host, path, rule, verdict or "allow"), u


def mined_by_hand(rows, support, confidence):
    """Every antecedent that leads to bad, by counting all token subsets."""
    from itertools import combinations
    from collections import Counter
    every, bad = Counter(), Counter()
    for tokens, is_bad in rows:
        for k in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), k):
                every[c] += 1
                bad[c] += is_bad
    return {c: bad[c] / every[c] for c in every if bad[c] >= support * len(rows) and bad[c] / every[c] >= confidence}


def test_mined_rules_and_matches_equal_brute_force(spark):
    rnd = random.Random(3)
    urls = [f"http{rnd.choice(['', 's'])}://{rnd.choice(['pills', 'news', 'blog'])}.{rnd.choice(['xx', 'yy'])}/{rnd.choice(['buy', 'read'])}/{i}" for i in range(300)]
    bad = [("pills" in u and "buy" in u) or (rnd.random() < 0.1) for u in urls]
    labelled = spark.createDataFrame(list(zip(urls, bad)), "url string, bad boolean")
    rows = labelled.select(url_filter.tokens(F.col("url")).alias("t"), "bad").collect()
    want = mined_by_hand([(r.t, r.bad) for r in rows], 0.05, 0.6)
    got = {tuple(r.antecedent): r.confidence for r in url_filter.mine(labelled, 0.05, 0.6).collect()}
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    everything = [(i, u, None) for i, u in enumerate(urls)] + [(0, urls[0], None), (900, "http://pills.zz/buy", None)]
    out = url_filter.judge(pages(spark, everything), labelled, rules=(), support=0.05, confidence=0.6).collect()
    assert len(out) == len(everything)
    for r in out:
        url = dict((i, u) for i, u, _ in everything)[r.page_id]
        tokens = set(spark.range(1).select(url_filter.tokens(F.lit(url)).alias("t")).first().t) if r.page_id == 900 else set(rows[r.page_id].t)
        fits = [c for a, c in want.items() if set(a) <= tokens]
        assert r.verdict == ("block" if fits else "allow") and (not fits or abs(r.confidence - max(fits)) < 1e-9)


def test_filter_runs_no_python_and_takes_empty_tables(spark):
    empty = spark.createDataFrame([], "url string, bad boolean")
    out = url_filter.judge(pages(spark, []), empty)
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan


# WARC

def test_warc_round_trip(spark):
    long = "<p>" + "z" * 3_000_000
    rows = [(5, "http://a/", "x" * 150), (3, "http://b/", "x" * 150), (9, None, "x" * 150), (4, "u\r\nInjected: 1", "short"), (6, "u", "short"),
            (7, "u", None), (8, "u", ""), (10, "é", "ü" * 60), (11, "é", "ü" * 60), (12, "l", long), (3, "http://b/", "x" * 150), (None, "n", "x" * 150)]
    index = warc.write(pages(spark, rows).repartition(3), frame=500)
    out = warc.read(index, payloads=True).collect()
    assert len(out) == len(rows)
    for i, u, h in rows:
        body = (h or "").encode()
        found = [r for r in out if r.page_id == i]
        first = min((j for j, _, t in rows if (t or "") == (h or "") and j is not None), default=None)
        again = len(body) >= 100 and i != first
        for r in found:
            assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
            assert (r.record_type, r.refers_to) == (("revisit", first) if again else ("response", None))
            assert (r.payload is None) if again else bytes(r.payload) == body
            assert r.url == (u.replace("\r", "%0D").replace("\n", "%0A") if u else None)


def test_a_record_is_fetched_by_its_frame_alone(spark):
    rows = [(i, f"http://h/{i}", f"<p>page {i}</p>" * 20) for i in range(60)]
    index = warc.write(pages(spark, rows).coalesce(1), frame=2_000)
    assert index.select("frame").distinct().count() > 5
    out = {r.page_id: bytes(r.payload).decode() for r in warc.fetch(index.filter(F.col("page_id").isin(7, 41))).collect()}
    assert out == {7: rows[7][2], 41: rows[41][2]}
    import zstandard
    from corpusflow.llm.common import file_system
    path = index.first().path
    system, place = file_system(path)
    data = zstandard.ZstdDecompressor().stream_reader(system.open_input_stream(place, compression=None), read_across_frames=True).read()
    assert data.count(b"WARC/1.1") == 60  # any reader of Zstandard sees one archive


def test_damaged_payloads_are_found():
    _, data = warc.record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    assert warc.parse(data)[0]["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"abc", b"abd"))


def test_warc_of_no_pages(spark):
    index = warc.write(pages(spark, []))
    assert index.count() == 0 and warc.read(index).count() == 0


# main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></ul></nav><!-- <p>no</p> --><div class="cookie-notice">We use</div>
<article class="post"><h1>Head &amp; tail</h1><p><b>One  two<br>three<p>Four&nbsp;five &lt;b&gt; &am</p><ul><li>a<li>b</ul><aside>side</aside>
<form>f<input value="x"></form><div id="comments"><p>nice</p></div><p>{0}</article><div class="box">same box</div><footer>f</footer>"""


def text_of(page):
    return html_text.main_text(html_text.parse(page))


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("plain  words\nhere", "plain words here"), ("<p>a<p>b", "a\n\nb"), ("<p>a<b>b</b>c", "abc"),
    (PAGE.format("End"), "Head & tail\n\nOne two three\n\nFour five <b> &am\n\na\n\nb\n\nEnd"),
    ("<div>a<script>x</script>b</div>c<p cla", "ab\n\nc"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"),
    ("</p></div>x</b>", "x"), ("<p hidden>a</p><p role='alert'>b</p><p class='Sidebar-Left'>c</p><p class=adult>d", "d"),
    ("<main><p>a</main><p>b", "a"), ("<article><header><h1>H</h1></header><p>x</article>", "H\n\nx"), ("<p>1 < 2 &#233; &#x41;", "1 < 2 é A"),
])
def test_main_text(page, text):
    assert text_of(page) == text


def test_deep_and_long_pages_are_read_whole():
    assert text_of("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    assert len(html_text.paths(html_text.parse("<div>" * 20_000 + "x"))) == 20_000
    assert text_of("<p>" + "word " * 200_000) == "word " * 199_999 + "word"


def test_branches_that_a_host_repeats_are_removed(spark):
    body = "<body><div class='top'>Always the same line</div><div class='text'><p>Story {0} begins</p><p>{1}</p></div></body>"
    rows = [(i, "http://one.example/x", body.format(i, "common" if i % 3 else f"own {i}")) for i in range(40)]
    rows += [(100 + i, f"http://h{i}.example/", body.format(i, "common")) for i in range(3)] + [(200, None, None), (0, "http://one.example/x", rows[0][2])]
    out = {r.page_id: r for r in html_text.extract(pages(spark, rows)).collect()}
    assert out[4].text == "Story 4 begins\n\ncommon" and out[3].text == "Story 3 begins\n\nown 3"
    assert out[101].text == "Always the same line\n\nStory 1 begins\n\ncommon"
    assert (out[200].text, out[200].n_chars, out[4].n_chars) == ("", 0, len(out[4].text))
    assert html_text.extract(pages(spark, rows)).count() == len(rows) and html_text.extract(pages(spark, [])).count() == 0


@pytest.mark.parametrize("body", ["<html><body><article><h1>Head</h1><p>{0}</p></article></body></html>", "<html><body><h1>Head</h1><p>{0}</p></body></html>",
                                  "<html><body><nav>{1}</nav><div><h1>Head</h1><p>{0}</p></div></body></html>"])
def test_copies_on_a_host_keep_their_text(spark, body):
    same = [(i, "http://copies.example/x", body.format("Equal text", i)) for i in range(60)]
    own = [(100 + i, "http://copies.example/y", body.format(f"Own text {i}", i)) for i in range(3)]
    out = {r.page_id: r.text for r in html_text.extract(pages(spark, same + own)).collect()}
    assert {out[i] for i, _, _ in same} == {"Head\n\nEqual text"}
    assert [out[100 + i] for i in range(3)] == [f"Head\n\nOwn text {i}" for i in range(3)]


def test_a_notice_on_few_pages_of_a_large_host_is_removed(spark):
    body = "<body><div class=text><p>Story {0}</p></div>{1}</body>"
    rows = [(i, "http://large.example/x", body.format(i, "<div class=end>Same line on a section</div>" if i < 50 else "")) for i in range(3000)]
    rows += [(i, "http://small.example/x", body.format(i, "<div class=end>Same line on a section</div>")) for i in range(5000, 5050)]
    rows += [(6000, "http://large.example/x", "<article>Marked</article>" + rows[0][2]), (None, "http://large.example/x", rows[1][2]), (0, *rows[0][1:])]
    out = html_text.extract(pages(spark, rows)).collect()
    assert len(out) == len(rows)
    assert {(r.page_id, r.text) for r in out} == {(i, f"Story {i}") for i, _, _ in rows[:3050]} | {(6000, "Marked"), (None, "Story 1")}


@pytest.mark.parametrize("body", ["<div><p>Same notice</p></div><div>{0}</div>", "<div>{0}</div><div><p>Same notice</p></div>",
                                  "<section>{0}<p>Same notice</section>", "<p>Same notice{0}"])
def test_unclassed_siblings_are_told_apart(spark, body):
    story = lambda i: [f"Story {i} {k}" for k in range(1 + i % 4)]
    rows = [(i, "http://plain.example/x", "<html><body>" + body.format("".join(f"<p>{x}</p>" for x in story(i))) + "</body></html>") for i in range(40)]
    out = {r.page_id: r.text for r in html_text.extract(pages(spark, rows)).collect()}
    assert out == {i: "\n\n".join(story(i)) for i in range(40)}


def test_paragraphs_in_many_presentations_stay(spark):
    tags = [a + b for a in "bius" for b in ("", *"bius")] + ["em", "strong", "code", "q", "sub", "sup", "small", "var", "kbd", "cite"]
    tags = [f"x{t}" for t in tags]
    rows = [(i, "http://many.example/x", f"<p>Story {i}</p>" if i >= len(tags) else f"<p>Story {i}<{tags[i]}></{tags[i]}></p>") for i in range(3000)]
    rows = [(i, u, h + "<div>Top line</div>") for i, u, h in rows]
    out = {r.page_id: r.text for r in html_text.extract(pages(spark, rows)).collect()}
    assert out == {i: f"Story {i}" for i in range(3000)}


def test_low_branches_spare_marked_articles_and_never_empty_a_page():
    low = lambda page: frozenset(html_text.paths(html_text.parse(page)))
    for page, text in (("<html><body><main><p>a<p>b</main></body>", "a\n\nb"), ("<body><div><p>a</p></div></body>", "a")):
        assert html_text.main_text(html_text.parse(page), low(page)) == text


def test_importance_against_the_formula(spark):
    import math
    rows = [(f"<div class=a>{'x' if i < 9 else i}</div>", i) for i in range(10)]
    frame = spark.createDataFrame([("h", p) for p, _ in rows], "host string, html string")
    low = html_text.low_paths(frame, least=2.0).first().low
    assert len(low) == 1
    entropy = -(0.9 * math.log(0.9) + 0.1 * math.log(0.1)) / math.log(10)
    weight = html_text.GAMMA
    value = weight * entropy
    assert html_text.low_paths(frame, least=value + 1e-6).count() == 1 and html_text.low_paths(frame, least=value - 1e-6).count() == 0


def test_mining_ends_on_long_urls_and_drops_rare_tokens(spark):
    deep = "/".join(f"s{k}" for k in range(40))
    rows = [(f"http://a.example/{deep}/{i}", True) for i in range(8)] + [(f"http://b.example/x{i}/y", False) for i in range(30)]
    rows += [("http://b.example/once/rare/z", True)]
    rules = url_filter.mine(spark.createDataFrame(rows, "url string, bad boolean"), 0.0005, 0.6).collect()
    assert rules and len(rules) < 2 ** url_filter.TRANSACTION + 1
    assert not any({"p:once", "p:rare"} & set(r.antecedent) for r in rules)
    few = spark.createDataFrame([(f"http://c.example/{deep}", True)], "url string, bad boolean")
    assert url_filter.mine(few).count() == 0


def test_no_token_of_a_long_url_is_left_out_of_rules(spark):
    deep = "/".join(f"t{chr(97 + k)}" for k in range(13))
    rows = [(f"http://e.example/{deep}/x/y/{i}", True) for i in range(20)] + [(f"http://e.example/{deep}/{i}", False) for i in range(10)]
    rows += [(f"http://f.example/{w}/{i}", False) for w in "xy" for i in range(30)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    # each of x and y is bad in 20 of 50, all of the 13 more often, both together always
    seen = ["http://n.example/x/y/1", "http://n.example/td/2", "http://n.example/x/3"]
    out = url_filter.judge(pages(spark, [(i, u, None) for i, u in enumerate(seen)]), labelled, rules=(), support=0.05, confidence=0.6).collect()
    got = {r.page_id: (r.verdict, r.confidence and round(r.confidence, 6)) for r in out}
    assert got == {0: ("block", 1.0), 1: ("block", round(20 / 30, 6)), 2: ("allow", None)}


def test_tokens_with_equal_marks_in_different_rows_stay_apart(spark):
    each = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (1, "c"), (2, "c")], "row long, token string")
    useful = spark.createDataFrame([("a", 2, 2, 0, 0), ("b", 2, 2, 0, 0), ("c", 2, 2, 7, 7)], "token string, n_bad long, n long, mark_1 long, mark_2 long")
    got = {r.token: (r.item, r.alike) for r in url_filter.alike(each, useful).collect()}
    assert got == {"a": ("a", ["a"]), "b": ("b", ["b"]), "c": ("c", ["c"])}


@pytest.mark.parametrize("tag", ["article", "div"])
def test_an_unclassed_notice_goes_from_marked_and_unmarked_pages(spark, tag):
    body = f"<html><body><{tag}><p>The same notice on every page</p><h1>Head {{0}}</h1><p>Story {{0}}</p></{tag}></body></html>"
    rows = [(i, "http://notice.example/x", body.format(i)) for i in range(20)] + [(100, "http://notice.example/x", body.format(3))]
    rows += [(200, "http://notice.example/x", f"<html><body><{tag}><p>Another first line</p><h1>Head 200</h1><p>Story 200</p></{tag}></body></html>")]
    out = {r.page_id: r.text for r in html_text.extract(pages(spark, rows)).collect()}
    assert all(out[i] == f"Head {i}\n\nStory {i}" for i in range(20)) and out[100] == out[3]
    if tag == "article":
        assert out[200] == "Another first line\n\nHead 200\n\nStory 200"


def plain_tree(rows, least=html_text.LEAST, least_pages=html_text.PAGES):
    """Main texts by merging the pages of a host in dictionaries and removing low branches from each."""
    import math
    from collections import Counter
    hosts = {}
    for i, url, page in rows:
        hosts.setdefault((url or "").split("://")[-1].split("/")[0], []).append((i, html_text.parse(page)))
    out = {}
    for own in hosts.values():
        once = {}
        for _, root in own:
            found = html_text.paths(root)
            value = html_text._hash(*sorted((p, s, t) for p, (s, t) in found.items()))
            text = html_text.main_text(root)
            if text not in once or value < once[text][0]:
                once[text] = (value, found)
        shapes, contents = {}, {}
        for _, found in once.values():
            for p, (s, t) in found.items():
                shapes.setdefault(p, Counter())[s] += 1
                contents.setdefault(p, Counter())[t] += 1

        def entropy(c):
            n = sum(c.values())
            return 1.0 if n < 2 else -sum(x / n * math.log(x / n) for x in c.values()) / math.log(n)
        low = {}
        for p, c in contents.items():
            weight = html_text.GAMMA ** len(shapes[p])
            importance = (1 - weight) * entropy(shapes[p]) + weight * entropy(c)
            if sum(c.values()) >= least_pages and importance < least and html_text.GAMMA * entropy(c) < least:
                low[p] = c.most_common(1)[0]
        for i, root in own:
            found, starts = html_text.paths(root), html_text.articles(root)
            inside = html_text.removable(root, starts) if starts else set(found)
            gone = {p for p in inside & low.keys() if not starts or low[p][1] >= least_pages and low[p][0] == found[p][1]}
            out[i] = html_text.main_text(root, frozenset(gone))
    return out


def test_extraction_equals_plain_merging(spark):
    rnd = random.Random(12)
    rows = []
    for i in range(150):
        parts = [f"<p>{rnd.choice(['Same line', 'Same line', 'Same line', f'Own {i}'])}</p>", f"<p>Story {i}</p>", "<div class=end>Foot line</div>"]
        if rnd.random() < 0.2:
            rnd.shuffle(parts)
        tag = rnd.choice(["article", "main", "div", "section"])
        rows.append((i, f"http://h{rnd.randint(0, 3)}.example/{i}", f"<html><body><{tag}>{''.join(parts)}</{tag}>{'<p>Below</p>' if i % 2 else ''}</body></html>"))
    rows += [(500 + k, *rows[k][1:]) for k in range(20)]
    out = {r.page_id: r.text for r in html_text.extract(pages(spark, rows)).collect()}
    assert out == plain_tree(rows)
