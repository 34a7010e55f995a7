from fleetlens.llm import wrappers

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body>"
    "<header><a href=/>Home</a></header><nav><ul>{items}</ul></nav><!-- ad --><div class=ad>Buy</div>"
    "<div id='cookie-banner'>We use cookies</div><article><h1>{title}</h1>{body}"
    "<form><input><button>Send</button></form><section class='comments'><p>First!</p></section></article>"
    "<aside>More</aside><footer>&copy; x</footer></body></html>"
)


def page(title="A &amp; B", body="<p>One</p>", items="<li><a>x</a></li>"):
    return PAGE.replace("{title}", title).replace("{body}", body).replace("{items}", items)


def wrapper_of(*pages):
    whole = None
    for p in pages:
        own = wrappers.fold_page(wrappers.read_page(p)[0])
        whole = wrappers.merge(whole, own) if whole else own
    return whole


def text_of(html, *others):
    return wrappers.main_text(html, *wrappers.content_slots(wrapper_of(html, *others)))


def test_article_without_its_surroundings():
    assert text_of(page()) == "A & B\nOne"


def test_blocks_white_space_and_references():
    body = "<p>a<b> b</b>\n\t c<br>d &lt;x&gt; &eacute;&#233;&#x41;</p><p> </p><ul><li>i<li>j</ul>tail"
    assert text_of(page(body=body)) == "A & B\na b c d <x> ééA\ni\nj\ntail"


def test_unclosed_truncated_and_odd_pages():
    assert text_of("<article><p>one<b>two<p>three <i") == "onetwo\nthree"
    assert text_of("<article><p title=\"a>b\" data-x='<p>'>one</p><script>var x='</article>'") == "one"
    assert text_of("") == "" and text_of("<") == "<" and text_of("plain &amp; simple") == "plain & simple"
    assert text_of("<p>1 < 2 and 3 > 2</p></div></p><!-- open") == "1 < 2 and 3 > 2"
    assert text_of("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"
    assert text_of("<p>x</p><![CDATA[<y> &amp;]]>") == "x\n<y> &amp;"
    deep = "<div><section>" * 20_000 + "deep"
    assert text_of(deep) == "deep"
    assert len(text_of("<article>" + "<p>word</p>" * 20_000).split("\n")) == 20_000


def test_alignment_infers_repeats_options_and_slots():
    one = "<body><h1>Same</h1><ul><li>a</li><li>b</li></ul><p>x</p></body>"
    two = "<body><h1>Same</h1><div class=note>!</div><ul><li>c</li></ul><p>y</p><p>z</p></body>"
    expected = "<>(<body>(<h1>(#)<div.note>(#)?<ul>(<li>(#)+)<p>(#)+))"
    assert wrappers.expression(wrapper_of(one, two)) == expected
    assert wrappers.expression(wrapper_of(two, one)) == expected
    pairs = "<body>" + "<h2>a</h2><p>b</p>" * 3 + "</body>"
    assert wrappers.expression(wrapper_of(pairs)) == "<>(<body>((<h2>(#)<p>(#))+))"
    known = wrappers.encode(wrapper_of(one, two))
    assert wrappers.encode(wrappers.decode(known)) == known


def test_without_an_article_fixed_texts_and_link_lists_go():
    pages = [f"<div class=top>Our site</div><ul><li><a>n{i}</a></li></ul><div class=body><p>text {i}</p></div>" for i in range(4)]
    assert text_of(pages[0], *pages[1:]) == "text 0"


def test_copies_of_a_page_are_one_page():
    assert text_of(*["<p>none</p>"] * 3) == "none"
    copies = ["<h1>Head</h1><p>body</p>"] * 4
    assert text_of(*copies) == "Head\nbody"
    varied = [f"<h1>Head</h1><p>body {i}</p>" for i in range(3)]
    assert text_of(*copies, *varied[:1]) == "Head\nbody"
    assert text_of(*varied) == "body 0"
    assert text_of("<h1>Head</h1>", *varied) == "Head"


def test_copies_do_not_depend_on_batches(spark):
    rows = [(i, None, "<p>none</p>") for i in range(6)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for n in (1, 10_000):
            spark.conf.set(key, n)
            pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
            assert [r["text"] for r in wrappers.extract(pages, wrappers.infer(pages)).collect()] == ["none"] * 6
    finally:
        spark.conf.set(key, before)


def test_on_spark(spark):
    rows = [
        (1, "https://u@A.example:80/x", page(), "c"), (1, "https://u@A.example:80/x", page(), "c"),
        (2, "http://a.example/y", page(body="<p>Two</p><p>Three</p>"), "c"), (3, None, "<p>none</p>", "c"),
        (4, "no url", None, "c"), (5, "http://b.example", "", "c"), (None, "http://b.example/z", page(title="Z", body=""), "c"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    found = wrappers.extract(pages, wrappers.infer(pages)).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in found) == [
        (0, "Z"), (1, "A & B\nOne"), (1, "A & B\nOne"), (2, "A & B\nTwo\nThree"), (3, "none"), (4, ""), (5, "")
    ]
    assert {r["host"] for r in wrappers.infer(pages).collect()} == {"a.example", "b.example", ""}
    none = pages.limit(0)
    assert wrappers.extract(none, wrappers.infer(none)).count() == 0


def test_against_plain_reading_of_the_sample(spark, small):
    import html
    import re

    pages = spark.read.parquet(f"{small}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in wrappers.extract(pages, wrappers.infer(pages)).collect()}
    for r in pages.collect():
        inside = r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>|<br>", inside))
        assert found[r["page_id"]] == "\n".join(b for b in blocks if b)


def test_headings_of_the_story_stay():
    pages = [f"<div class=top>Our site</div><p>lead {i}</p><h2>Ingredients</h2><p>text {i}</p><div class=note>Join us</div>" for i in range(5)]
    assert text_of(*pages) == "lead 0\nIngredients\ntext 0"


def test_class_words_in_company_are_decided_by_the_wrapper():
    body = "<p>s{i}</p><div class=share-price>price {i}</div><div class=author-comment>I think {i}</div><div class=share-hint>Tell a friend</div>"
    pages = [f"<article><h1>t{i}</h1>{body.replace('{i}', str(i))}</article>" for i in range(4)]
    assert text_of(*pages) == "t0\ns0\nprice 0\nI think 0"
    assert text_of(pages[0]) == "t0\ns0\nprice 0\nI think 0\nTell a friend"  # one page tells nothing
    voices = "".join(f"<div class='visitor-comment'><p>v{k}</p></div>" for k in range(3))
    assert text_of(*[p.replace("</article>", voices + "</article>") for p in pages]) == "t0\ns0\nprice 0\nI think 0"


def test_teasers_and_link_boxes():
    pages = [
        f"<article class=teaser><p>teaser {i}</p></article><div class=body><p>text {i}</p>"
        f"<div class=box>Read also <a>story {i}</a></div><p>more <a>x</a> {i}</p></div>"
        for i in range(4)
    ]
    assert text_of(*pages) == "text 0\nmore x 0"


def test_wrapper_size_does_not_grow_with_pages():
    import random
    import re

    r = random.Random(3)

    def odd(i):
        parts = [r.choice(["<p>a</p>", "<h2>b</h2>", "<ul><li>c</li></ul>", "<table><tr><td>d</table>", "<pre>e</pre>"]) for _ in range(40)]
        parts = [re.sub(r">(\w)<", rf">\g<1>{i}-{k}<", part) for k, part in enumerate(parts)]
        return f"<nav><p id=n{i}>x</p></nav><div id=post-{i} class='c{i}x'><h2 id='title-{i}'>t</h2>{''.join(parts)}</div><div class=comments><p id=c{i}>c</p></div>"

    sizes = [len(wrappers.encode(wrapper_of(*[odd(i) for i in range(n)]))) for n in (20, 100, 500)]
    assert sizes[2] <= sizes[1] * 1.1 < 3_000
    pages = [odd(i) for i in range(50)]
    slots = wrappers.content_slots(wrapper_of(*pages))
    for p in pages:
        assert wrappers.main_text(p, *slots).count("\n") == 40


def test_wrappers_that_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "BROADCAST_CHARS", 0)
    rows = [(i, "http://a.example/", page(title=f"t{i}")) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r["page_id"]: r["text"] for r in wrappers.extract(pages, wrappers.infer(pages)).collect()}
    assert found == {i: f"t{i}\nOne" for i in range(30)}
