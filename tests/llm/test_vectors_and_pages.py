"""Product codes, hard negatives and main text against plain Python versions, with nulls, ties, repeats and odd columns."""

import collections
import hashlib
import os.path
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sequent.llm import codes, maintext, negatives

VECTORS = "vec_id long, embedding array<float>, label int"


def vector_rows(n, d, seed, odd=True):
    draw = np.random.default_rng(seed)
    x = draw.standard_normal((n, d)).astype("f4")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(k, x[k].tolist(), int(k % 7) if k % 11 else None) for k in range(n)]
    rows += [(1000 + k, rows[3][1], 3) for k in range(n // 2)]  # a third of all rows is one vector
    if odd:
        rows += [(5000, None, 1), (5001, [None] + rows[0][1][1:], 1), (5002, [float("nan")] * d, 1), (5003, [float("inf")] * d, None), (5004, [0.0] * d, 2), (5005, [1e30] * d, 2), (5006, rows[1][1][:8], 2), (5007, [], 2), (None, rows[2][1], 1), (7, rows[7][1], 0), (7, rows[8][1], 0)]
    return rows


def clash(df):
    return df.withColumns({c: F.lit("clash") for c in ("position", "entry", "salt", "n", "x0", "code", "error", "d", "b", "s", "at", "blocks", "slabs", "vector", "rank")})


def plain_codes(rows, parts, entries, rounds, scale):
    fine = [r for r in rows if r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1])]
    ints = [[max(-codes.LARGEST, min(codes.LARGEST, int(np.floor(scale * float(np.float32(v)))))) for v in r[1]] for r in fine]
    order = sorted(range(len(fine)), key=lambda i: (fine[i][0] is None, fine[i][0] or 0, [float(np.float32(v)) for v in fine[i][1]]))
    d = len(ints[order[0]])
    width = d // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    own = [cut(v) if len(v) == d else None for v in ints]
    book = [[own[i][p] for i in order[:entries] if own[i]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            members = collections.defaultdict(list)
            for v in own:
                if v:
                    members[nearest(p, v[p])[1]].append(v[p])
            new.append([[sum(c) // len(members[e]) for c in zip(*members[e], strict=True)] if e in members else c for e, c in enumerate(book[p])])
        book = new
    digest = hashlib.sha256(",".join(str(x) for p in book for c in p for x in c).encode()).hexdigest()
    found, labels = [], collections.Counter()
    for r, v in zip(fine, own, strict=True):
        near = [nearest(p, v[p]) for p in range(parts)] if v else None
        found.append((r[0], r[2], "".join(f"{e:02x}" for _, e in near) if v else None, sum(e for e, _ in near) if v else None))
        labels[r[2]] += found[-1][3] or 0
    return collections.Counter((i, code, error, labels[label], digest) for i, label, code, error in found)


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_vector_codes(spark, rounds, monkeypatch):
    rows = vector_rows(150, 32, 5)
    got = codes.vector_codes(clash(spark.createDataFrame(rows, VECTORS).repartition(5)), parts=4, entries=6, rounds=rounds)
    assert collections.Counter(map(tuple, got.collect())) == plain_codes(rows, 4, 6, rounds, 4096)


def test_vector_codes_of_few_rows(spark):
    assert codes.vector_codes(spark.createDataFrame([], VECTORS)).collect() == []
    one = codes.vector_codes(spark.createDataFrame([(4, [0.5] * 16, None)], VECTORS)).collect()
    assert [tuple(r)[:4] for r in one] == [(4, "00" * 8, 0, 0)]
    uneven = codes.vector_codes(spark.createDataFrame([(4, [0.5] * 15, 1), (5, [0.5] * 16, 1)], VECTORS)).collect()
    assert [(r.code, r.error) for r in uneven] == [(None, None)] * 2


def test_members_of_a_hot_entry_have_salts_and_only_movers_are_dealt_again(spark, monkeypatch):
    rows = vector_rows(300, 16, 3, odd=False)
    written = []
    keep = codes.stored

    def watch(df, name):
        out = keep(df, name)
        written.append((name, out.count(), out.where("moves").count() if "moves" in out.columns else None))
        return out

    monkeypatch.setattr(codes, "stored", watch)
    codes.vector_codes(spark.createDataFrame(rows, VECTORS), parts=2, entries=8).collect()
    members = [n for name, n, _ in written if name == "members"]
    moves = [m for name, _, m in written if name == "moved"]
    assert members[0] == 2 * len(rows) and members[1:] == moves[: len(members) - 1] and max(members[1:]) < members[0]
    total = np.zeros((1, 2, 3), object)
    total[0, :, 0] = 9000, 1000
    assert codes.salts_for(total, 2).tolist() == [[2, 1]]


def plain_negatives(rows, is_anchor, positives, wanted):
    usable, out = {}, []
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v):
            ints = [max(-negatives.LARGEST, min(negatives.LARGEST, int(np.floor(256 * float(np.float32(x)))))) for x in v]
            key = (i, label, len(v))
            usable[key] = min(usable.get(key, ints), ints)
    for a, v in usable.items():
        if is_anchor(a[0]):
            scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), b[0], b[1]) for b, w in usable.items() if b[2] == a[2]]
            for s, p, _ in sorted(x for x in scored if x[2] == a[1] and x[1] != a[0])[:positives]:
                window = sorted(x for x in scored if x[2] != a[1] and 50 * -s <= 100 * -x[0] <= 95 * -s)[:wanted]
                out += [(a[0], p, k, n[1], -s, -n[0]) for k, n in enumerate(window, 1)]
    return collections.Counter(out)


@pytest.mark.parametrize("d", [6, 32])
def test_hard_negatives(spark, d):
    rows = vector_rows(400, d, 9)
    rows += [(2000 + k, rows[k][1], (rows[k][2] or 0) + 1) for k in range(40)] + [(9, rows[9][1], 6)]  # ties, and an id with two labels
    df = clash(spark.createDataFrame(rows, VECTORS).repartition(6))
    got = negatives.hard_negatives(df, df.where(F.col("vec_id") % 9 == 0), block=50, slab=7)
    want = plain_negatives(rows, lambda i: i % 9 == 0, 5, 3)
    assert len(want) > 200 and collections.Counter(map(tuple, got.collect())) == want
    assert negatives.hard_negatives(df.limit(0), df).count() == 0 == negatives.hard_negatives(df, df.limit(0)).count()


def test_threshold_stops_early_and_sees_ties():
    draw = np.random.default_rng(2)
    x = draw.integers(-3, 4, (4000, 3))
    x[:20] += np.array([200, 100, 50])
    lists = negatives.Lists(x, np.arange(4000))
    anchor = np.array([5, 3, 1])
    (bound,) = lists.thresholds(anchor[None])
    assert bound[0] >= (x @ anchor).max() and (np.diff(bound) <= 0).all()
    for low, high in ((-10**9, 10**9), (0, 20), (10**6, 10**7)):
        ((places, scores),) = lists.search(anchor, bound, np.ones(4000, bool), np.array([low]), np.array([high]), 5)
        want = sorted((-int(s), i) for i, s in enumerate(x @ anchor) if low <= s <= high)[:5]
        assert list(zip((-scores).tolist(), places.tolist(), strict=True)) == want
    # Twenty far better rows are found in the first steps: the threshold falls below them long before the lists end.
    kth = sorted(x @ anchor)[-5]
    assert next(k for k, t in enumerate(bound) if t < kth) <= 2


def plain_text(rows, alike):
    """The differencing in plain Python, runs and neighbours included."""
    pages = {}
    for i, url, page in rows:
        lines, undecided = maintext.lines_of(page)
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = rest.replace("?", "/").replace("#", "/").split("/")[0].lower()
        path = rest[len(host) :].split("?")[0].split("#")[0]
        pages[i, url, page] = (host, path, lines, undecided and bool(lines))
    open_pages = sorted((h, p, n) for n, (h, p, _, u) in enumerate(pages.values()) if u)
    values = list(pages.values())
    runs = []
    for h, p, n in open_pages:
        if runs and runs[-1][0] == h and runs[-1][2] == values[n][2]:
            runs[-1][3].append(n)
        else:
            runs.append((h, p, values[n][2], [n]))
    drop = {}
    for r, (h, p, lines, own) in enumerate(runs):
        near = [runs[k] + (k,) for k in (r - 1, r + 1) if 0 <= k < len(runs) and runs[k][0] == h]
        near.sort(key=lambda x: (-len(os.path.commonprefix([p, x[1]])), x[4]))
        for other in near:
            same = set(maintext.common(lines, other[2]))
            if sum(len(lines[i]) for i in same) < alike * min(sum(map(len, lines)), sum(map(len, other[2]))):
                drop |= dict.fromkeys(own, same)
                break
    text = {key: "\n".join(x for i, x in enumerate(v[2]) if i not in drop.get(n, ())) for n, (key, v) in enumerate(pages.items())}
    return collections.Counter((i, url, text[i, url, page], len(text[i, url, page])) for i, url, page in rows)


def sites():
    random.seed(4)
    text = lambda: " ".join(random.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(random.randint(20, 40)))
    rows = []
    for host in ("a.example.org", "b.example.org"):
        top = "".join(f"<div>{host} {x}</div>" for x in ("Home", "About us", "All news"))
        for k in range(30):
            own = "".join(f"<p>{text()}" for _ in range(random.randint(2, 5)))
            rows.append((len(rows), f"https://{host}/{'news' if k % 2 else 'blog'}/{k:02d}?x=1", f"<html><body><div class=top>{top}</div><h1>Story {k} of {host}</h1>{own}<div>Copyright {host}</div></body>"))
        rows += [(100 + len(rows) + k, f"http://{host}/blog/04/copy{k:03d}", rows[-26][2]) for k in range(40)]
    return rows


def test_main_text_against_plain_python(spark):
    rows = sites()
    rows += [(500, None, None), (501, None, ""), (502, "x", "<p>one<p>two"), (503, None, "<p>one<p>three"), (None, "http://c.org/", "<p>solo"), (504, "http://c.org/z", "<article><h1>T</h1><p>a&amp;b&nbsp;c</article><footer>f</footer>"), rows[5], rows[5], (505, "http://c.org/y", "<p>" + "w " * 300_000 + "<p>end")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("h", "g", "host", "path", "lines", "run", "drop", "part", "local", "text")})
    got = maintext.main_text(df.repartition(9))
    want = plain_text(rows, 0.8)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and collections.Counter(map(tuple, got.collect())) == want
    texts = {r[0]: r[2] for r in want}
    # Menus and footers of sites without telling markup are gone, the articles stay whole, copies are all alike.
    for i, url, page in rows[:150]:
        if i is not None and url and ".example.org" in url:
            assert "About us" not in texts[i] and "Copyright" not in texts[i] and texts[i].startswith("Story") and texts[i].count("\n") == page.count("<p>")
    assert texts[504] == "T\na&b c" and len(texts[505]) == 600_003
    assert maintext.main_text(df.limit(0)).count() == 0


def test_pages_with_an_article_are_neighbours_too(spark):
    """One page of the site lacks an article element: what it shares with the others' unmarked lines and menus goes."""
    menu, end = "<li>Home<li>About us<li>All the news", "<div>Copyright of the site</div>"
    whole = f"<nav><ul>{menu}</ul></nav><article><h1>{{0}}</h1><p>The story of {{0}} told at length<p>A common line</article>{end}"
    rows = [(k, f"https://a.org/n/{k}", whole.format(f"page {k}")) for k in (1, 2, 4, 5)]
    rows.append((3, "https://a.org/n/3", f"<ul>{menu}</ul><h1>page 3</h1><p>The story of page 3 told at length and more{end}"))
    got = {r["page_id"]: r["text"] for r in maintext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "page 3\nThe story of page 3 told at length and more"
    assert all(got[k] == f"page {k}\nThe story of page {k} told at length\nA common line" for k in (1, 2, 4, 5))


def test_copies_do_not_hide_each_others_lines_from_a_neighbour(spark):
    """Copies of one article are one run, but the page beside it is held against the copy that is nearest, with that one's menu."""
    menu, article = "<ul><li>Home<li>About us<li>All the news</ul>", "<article><h1>page 1</h1><p>A story that two pages tell</article>"
    pages = [article, menu + article, menu + "<h1>page 3</h1><p>The story of page 3 told at length"]
    rows = [(k, f"https://a.org/n/{k}", page) for k, page in enumerate(pages)] + [(10 + k, f"https://b.org/n/{9 - k}", page) for k, page in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in maintext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == got[12] == "page 3\nThe story of page 3 told at length"
    assert got[0] == got[1] == got[10] == got[11] == "page 1\nA story that two pages tell"


def test_pages_with_an_article_are_differenced_too(spark):
    """What neighbours share is told of every page, and deleted only where markup leaves it open."""
    page = "<nav><p>Home</nav><article><h1>{0}</h1><p>Story {0} told at length, in many words<p>Read more of our news</article><p>Imprint"
    rows = [(k, f"https://a.org/n/{k}", page.format(f"page {k}")) for k in (1, 2, 3)]
    rows += [(4, "https://b.org/n/4", "<p>no neighbour"), (5, "https://c.org/n/5", None), (6, "https://a.org/n/4", "<h1>page 6</h1><p>Story page 6 told without an article<p>Read more of our news<p>Imprint")]
    got = {r["page_id"]: (r["text"], r["n_shared"]) for r in maintext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), shared=True).collect()}
    assert {k: v for k, v in got.items() if k < 4} == {k: (f"page {k}\nStory page {k} told at length, in many words\nRead more of our news", 1) for k in (1, 2, 3)}
    assert got[4] == ("no neighbour", 0) and got[5] == ("", 0) and got[6] == ("page 6\nStory page 6 told without an article", 2)


PAGES = [
    ('<div class="page no-sidebar"><header><h1>Site</h1></header><div id=menu><ul><li>a<li>b</ul></div><div class=post><h2>T &amp; x</h2><p>One<p>Two <i>in</i>line<span hidden>no</span><br>x<table><tr><td>c1<td>c2</table></div><div class="cookie-notice">eat</div><div id="comments"><p>bad</p></div></div>', ["T & x", "One", "Two inline x", "c1", "c2"], True),
    ("<main><article><header><h1>H</h1></header><p>a &lt; b &nbsp; c<aside>no</aside><form><p>no</form><p>d</article><div class=share>no</div></main>", ["H", "a < b c", "d"], False),
    ('<main><h1>t</h1><p>x<script>var s = "</p>";</script>y</main><p>out', ["t", "xy"], False),
    ("<article></article><p>k", ["k"], True),
    ("a < b > c<!-- no --><style>p{}</style>", ["a < b > c"], True),
    ('<p>un"closed <a href="x>link</a> after', ['un"closed link after'], True),
    ("<nav><p>n</nav><article><p>kept<div class=ad>ad</div><section class='reader-comments'><article><p>c</article></section><p>more</article>", ["kept", "more"], False),
]


@pytest.mark.parametrize("page, lines, undecided", PAGES)
def test_lines_of_a_page(page, lines, undecided):
    assert maintext.lines_of(page) == (lines, undecided)


def lcs(a, b):
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
    return size[-1][-1]


@pytest.mark.parametrize("most", [8, 1 << 26])
def test_longest_common_subsequence(most):
    random.seed(1)
    for _ in range(1500):
        k = random.choice([2, 5, 20])
        a, b = ([random.randrange(k) for _ in range(random.randint(0, 14))] for _ in range(2))
        found = maintext.common(a, b, most)
        rest = iter(b)
        assert len(found) == lcs(a, b) and found == sorted(set(found)) and all(a[i] in rest for i in found)
