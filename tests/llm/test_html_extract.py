import random
import re

from quoin.llm.html_extract import blocks, chosen, common, extract

PAGE = (
    "<html><head><title>t</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body><header><a href=/>Home</a></header><nav><ul><li>Menu</ul></nav>"
    "<div class='cookie-notice'>We use cookies</div><main><article><header><h1>T &amp; U</h1><p>byline</p></header><p>One&nbsp; two<br>three<p>Four <b>five</b> six<ul><li>a<li>b</ul>"
    "<form>Name <input></form><div class=advert>Buy</div><section id=comments><p>reader</p></section></article></main><aside>side</aside><footer>&copy; f</footer>"
)


def test_article_without_furniture():
    assert text_of(PAGE) == ["T & U", "One two three", "Four five six", "a", "b"]


def text_of(page):
    found = blocks(page)
    return [found[i].line for i in chosen(found)[0]]


def test_a_form_around_the_page_hides_nothing_and_a_readers_form_is_out():
    body = "<nav><a href=/>Home</a></nav><div class=login><p>Sign in</p></div><h1>Title</h1><p>Story text.</p><footer>end</footer>"
    for form in ("<form>", "<form id=aspnetForm action=/x>", '<form class="form" method=post>'):
        assert text_of(f"<body>{form}{body}</form>") == ["Title", "Story text."]
        assert text_of(f"<body>{form}<nav>Menu</nav><article>{body}</article></form>") == ["Title", "Story text."]
        assert text_of(f"<body><p>Story text.</p>{form}<p>Your name</p></form>") == ["Story text."]
        assert text_of(f"<body><article><p>Story text.</p>{form}<p>Your name</p></form></article>") == ["Story text."]
    assert text_of("<body><p>Story text.</p><form class='search form'>Find</form>") == ["Story text."]


def test_title_and_lead_before_the_article_stay():
    page = "<body><nav>Menu</nav><main><h1>Title</h1><p>The lead.</p><article><p>First.</p><p>Second.</p></article><div class=related>More</div></main><footer>f</footer>"
    assert text_of(page) == ["Title", "The lead.", "First.", "Second."]


def test_a_teaser_beside_the_story_is_not_the_text():
    story = "<div class=post-content><h1>Title</h1>" + "".join(f"<p>Paragraph {i} of the long story goes on.</p>" for i in range(5)) + "</div>"
    teaser = "<article class=card><a href=/x>Another story</a><p>Read on</p></article>"
    for page in (f"<body>{story}{teaser}{teaser}", f"<body>{teaser}{story}"):
        assert text_of(page) == ["Title", *(f"Paragraph {i} of the long story goes on." for i in range(5))]
    assert text_of(f"<body><div class=content>{teaser}</div>") == ["Another story", "Read on"]


def test_pages_of_links_only_keep_them():
    assert text_of("<body><p><a href=/a>One</a></p><p><a href=/b>Two</a></p>") == ["One", "Two"]
    assert text_of("<body><p><a href=/a>One</a></p><p>Two</p>") == ["Two"]


def test_common_subsequences_are_longest():
    draw = random.Random(0)
    for _ in range(300):
        a, b = ([draw.randrange(4) for _ in range(draw.randrange(14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = common(a, b)
        assert len(found) == best[-1][-1] and found == sorted(set(found))
        rest = iter(b)
        assert all(a[i] in rest for i in found)


def test_unmarked_pages_lose_what_they_share_with_their_neighbours(spark):
    page = lambda k: f"<body><div>Site name</div><div>Top stories</div><p>Own text number {k} goes on here</p><p>More of {k}</p><div>All rights</div>"
    rows = [(i, f"http://h.example/a/{i:03d}?x#y", page(i)) for i in range(60)]
    rows += [(100, "http://other.example/1", page(100)), (101, None, None), (102, "", ""), (103, "http://h.example/z", PAGE), (104, "http://c.example/1", page(5)), (105, "http://c.example/2", page(5))]
    got = {r.page_id: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(60):
        assert got[i].text == f"Own text number {i} goes on here\nMore of {i}", i
    assert "Site name" in got[100].text and got[101].text == got[102].text == ""
    assert got[103].text == "T & U\nOne two three\nFour five six\na\nb" and got[103].n_chars == len(got[103].text)
    assert "Own text number 5" in got[104].text and len(got) == len(rows)


def test_marked_pages_are_differenced_too(spark):
    """Stories shorter than the teasers beside them, and lines of the template inside main, by one mark after another."""
    teaser = "<div class=content>" + "".join(f"<p>The same long teaser {i} stands on every page of this host</p>" for i in range(3)) + "</div>"
    card = "<article><p>The same card</p></article>"
    copied = "<p>A passage that two pages have in common</p>"
    bodies = {
        "classes": lambda k: f"{teaser}<article><h1>Title {k}</h1><p>Story {k}</p><p>As always</p></article>",
        "cards": lambda k: f"{card}<article><h1>Title {k}</h1><p>Story {k}</p><p>As always</p></article>",
        "mains": lambda k: f"<main><div>You are here</div><h1>Title {k}</h1>{copied if k in (3, 4) else ''}<p>Story {k}</p></main>",
    }
    rows = [(100 * n + k, f"http://{name}.example/{k}", f"<body>{body(k)}") for n, (name, body) in enumerate(bodies.items()) for k in range(9)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(1, 8):
        assert got[k] == got[100 + k] == f"Title {k}\nStory {k}\nAs always", k
        assert got[200 + k] == "\n".join([f"Title {k}", *(["A passage that two pages have in common"] if k in (3, 4) else []), f"Story {k}"]), k


def test_groups_of_copies_are_held_against_the_pages_beyond_them(spark):
    page = lambda k: "<body><div>Site name</div>" + "".join(f"<p>Sentence {i} of {k}</p>" for i in range(4)) + "<div>All rights</div>"
    rows = [(10 * k + c, f"http://h.example/{k}?page={c}", page(k)) for k in range(4) for c in range(5)]
    rows += [(90 + c, f"http://lone.example/x?page={c}", page(9)) for c in range(3)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(4):
        assert {got[10 * k + c] for c in range(5)} == {"\n".join(f"Sentence {i} of {k}" for i in range(4))}
    assert all("Site name" in got[90 + c] and "All rights" in got[90 + c] for c in range(3))


def test_repeats_and_empty_table(spark):
    schema = "page_id long, url string, html string, text string, host int"
    rows = spark.createDataFrame([(1, "http://h/1", PAGE, "x", 1), (1, "http://h/1", PAGE, "x", 1), (None, None, "<p>a", None, None)], schema)
    assert sorted(str(r.page_id) for r in extract(rows).collect()) == ["1", "1", "None"]
    assert extract(rows.limit(0)).count() == 0


def test_deleted_lines_equal_a_plain_version(spark):
    """Pairing by host and path, and deleting what a longest common subsequence shares, page by page."""
    draw = random.Random(3)
    shared = [f"<p>Shared line {i}</p>" for i in range(6)]
    rows = []
    for i in range(80):
        own = [f"<p>Own line {draw.randrange(10**6)}</p>" for _ in range(draw.randrange(5, 9))]
        for line in draw.sample(shared, draw.randrange(0, 4)):
            own.insert(draw.randrange(len(own) + 1), line)
        rows.append((i, f"http://h{i % 3}.example/{draw.randrange(10**6):06d}", "<body>" + "".join(own)))
    lines = {i: re.findall("<p>(.*?)</p>", page) for i, _, page in rows}
    expected = {}
    for h in range(3):
        order = [i for _, i in sorted((url, i) for i, url, _ in rows if i % 3 == h)]
        for k, i in enumerate(order):
            gone = set()
            for j in (k - 1, k + 1):
                if 0 <= j < len(order):
                    gone |= set(common([hash(x) for x in lines[i]], [hash(x) for x in lines[order[j]]]))
            expected[i] = "\n".join(x for n, x in enumerate(lines[i]) if n not in gone)
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == expected


def test_a_very_long_page():
    page = "<body><article>" + "".join(f"<p>Line {i} &amp; more</p>" for i in range(200_000)) + "</article>"
    found = text_of(page)
    assert len(found) == 200_000 and found[-1] == "Line 199999 & more"


def test_lines_are_shuffled_once_for_both_neighbours(spark):
    draw = random.Random(5)
    own = lambda: "".join(f"<p>{draw.randrange(10**9)}</p>" for _ in range(200))
    rows = spark.createDataFrame([(i, f"http://h{i % 2}.example/{i:04d}", f"<body><p>Site name</p>{own()}") for i in range(300)], "page_id long, url string, html string")
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    none = jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList()

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(*none)
        return {(found.apply(i).stageId(), found.apply(i).attemptId()): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    before = stages()
    assert all(r.text.count("\n") == 199 for r in extract(rows).collect())
    moved = sum(n for i, n in stages().items() if i not in before)
    # with the order, with the neighbours, and the packed text
    assert moved < 3.5 * 300 * 201 * 8
