import random

from tributary.llm import html_extract as H

SCHEMA = "page_id long, url string, html string"


def page(title, paragraphs, foot, main="article"):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    inner = f"<{main}><h1>{title}</h1>{body}</{main}>" if main else f"<div><h1>{title}</h1>{body}</div>"
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{a:b}}</style><script>var t='</p><p>no'</script></head><body><nav><li><a href='/'>Home</a></li></nav>"
        f"<!-- <p>no</p> --><div class='cookie-notice'><div>We use cookies</div></div>{inner}<div>{foot}</div><section id=comments><p>nice</p></section><form>mail <input></form><footer>&copy; us</footer>"
    )


def texts(spark, rows, **columns):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["page_id"]: r for r in H.extract(df.withColumns(columns)).collect()}


def test_lines_and_zones():
    lines, zones = H.lines_of("<p>a&amp;b <b>c</b>d<br>e  \n f<p>g</p><div hidden>h</div><article>i<aside>j</aside></article>k")
    assert list(zip(lines, zones)) == [("a&b cd", "o"), ("e f", "o"), ("g", "o"), ("h", "b"), ("i", "m"), ("j", "b"), ("k", "o")]
    assert H.lines_of("<div class='post'>a<div class='share'>b</div></div>c") == (["a", "b", "c"], "mbo")
    assert H.lines_of("") == ([], "") and H.lines_of("just text < 3 &lt;") == (["just text < 3 <"], "o")
    assert H.lines_of("<nav>never closed<p>text</p>") == (["never closed", "text"], "oo")
    assert H.lines_of("<script>a") == ([], "")


def test_articles_and_differencing(spark):
    from pyspark.sql import functions as F

    rows, want = [], {}
    for i in range(12):
        own = [f"Paragraph {k} of page {i} &amp; more" for k in range(4)]
        main = "article" if i % 2 else ""
        rows.append((i, f"http://a.example/x/{i:02d}?q={i}", page(f"Title {i}", own, "The same line at the foot", main)))
        want[i] = " ".join([f"Title {i}", *(o.replace("&amp;", "&") for o in own)])
    rows += [(100, None, None), (101, "", ""), (102, "http://b.example/", "<p>alone</p>"), (102, "http://b.example/", "<p>alone</p>")]
    out = texts(spark, rows, lines=F.lit(1), text=F.lit("x"))
    assert {k: out[k]["text"] for k in want} == want
    assert all(out[k]["n_chars"] == len(want[k]) and out[k]["n_deleted"] > 0 for k in want)
    assert (out[100]["text"], out[101]["text"], out[100]["n_chars"]) == ("", "", 0)
    assert H.extract(spark.createDataFrame(rows, SCHEMA)).count() == len(rows)
    assert H.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_main_words_win_over_aside_words():
    for opening in ("div class='content no-sidebar'", "main class='with-sidebar'", "article class='post social-share-enabled'", "div class='entry-content'", "section id=post-content class=has-sidebar"):
        lines, zones = H.lines_of(f"<p>out<{opening}><p>text</p><div class='social-share'>b</div></{opening.split()[0]}>")
        assert dict(zip(lines, zones)) == {"out": "o", "text": "m", "b": "b"}, opening
    for opening in ("div class='sidebar'", "div class=cookie-notice", "article class='comment reply'", "div id=site-footer", "section class='related-posts'"):
        assert "b" in H.lines_of(f"<{opening}>x</{opening.split()[0]}>y")[1], opening


def plain_page(host, i, own, rng):
    """A page without article or main elements and without names: only its neighbours tell text from template."""
    menu = "".join(f"<div><a href=/{w}>{host} {w}</a></div>" for w in ("home", "news", "sport", "about us", "contact"))
    foot = f"<div>All rights of {host} reserved since long ago</div><div>Terms of use</div>"
    body = "".join(f"<div>{x}</div>" for x in own)
    return f"<html><body>{menu}<div><div>You are here</div>{body}<div>Read more on {host}</div></div>{foot}</body></html>"


def test_pages_without_article_elements(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for h in range(6):
        shared = f"A paragraph that two pages of host {h} quote, word for word."
        for i in range(2 if h == 0 else 9):
            own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(12, 60))) for _ in range(rng.randrange(2, 6))]
            if h and i in (3, 6):
                own.insert(1, shared)
            k = len(rows)
            rows.append((k, f"https://host{h}.example/{'en' if i % 2 else 'fr'}/{i:03d}", plain_page(f"host{h}", i, own, rng)))
            want[k] = " ".join(own)
    copy = len(rows)  # a copy of a page under another address
    rows.append((copy, rows[5][1] + "?print=1#x", rows[5][2]))
    want[copy] = want[5]
    out = texts(spark, rows)
    wrong = [k for k in want if out[k]["text"] != want[k]]
    assert not wrong, (wrong[:5], out[wrong[0]]["text"], want[wrong[0]])
    assert all(r["n_deleted"] >= 8 for r in out.values())
    assert texts(spark, rows[5:6])[5]["text"] != want[5]  # without neighbours the template stays: differencing does the work


def test_neighbours_across_ranges(spark):
    rows = [(f"h{i // 40}", f"/{i:04d}", str(i), i, [i], [1], "o") for i in range(120)]
    df = spark.createDataFrame(rows, "host string, path string, id string, rowkey long, marks array<long>, sizes array<int>, zones string")
    out = {r["rowkey"]: sorted(x[0] for x in r["near"]) for r in H.neighbours(df).collect()}
    assert out == {i: [j for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < 120 and j // 40 == i // 40] for i in range(120)}


def test_copies_of_an_article_stay_whole(spark):
    rows = [(i, f"http://c.example/{i}", page("One", ["Same text", "again", "and again"], "foot")) for i in range(5)]
    assert {r["text"] for r in texts(spark, rows).values()} == {"One Same text again and again"}


def test_frame_lines_inside_articles_go():
    own, zones = [9, 1, 2, 3, 8], "mmmmm"
    assert H.deleted(own, zones, [[9, 4, 5, 6, 7, 8], [9, 14, 15, 16, 17, 18]]) == []  # 2 of 5 lines are a copy's
    assert H.deleted([9, *range(20, 40)], "m" * 21, [[9, 1], [9, 2]]) == [0]


def test_common_subsequence_is_longest(monkeypatch):
    rng = random.Random(2)

    def length(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for bits in (10**9, 4):
        monkeypatch.setattr(H, "TABLE_BITS", bits)
        for _ in range(500):
            a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
            found = H.common(a, b)
            rest = iter(b)
            assert all(a[i] in rest for i in found) and len(found) == length(a, b) and found == sorted(set(found))
