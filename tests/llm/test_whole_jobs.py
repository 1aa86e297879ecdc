"""Whole jobs of corpus operators on small tables."""

import random

from cuemill.llm import decontaminate, html


def test_role_words_are_whole_class_tokens():
    article = "<article><header class='entry-header'><h1>Title</h1></header><p>Text</p></article>"
    for c in ("content no-sidebar", "with-sidebar", "post no-comments", "sidebar", "related-posts"):
        assert html.extract(f"<body><div class='{c}'>{article}</div><div class='ad'>Buy</div></body>", None) == "Title\nText"
    assert html.extract("<body><div class='entry-header'><h1>Title</h1></div><p class='no-comments'>Text</p></body>", None) == "Title\nText"
    for c in ("ad", "post sidebar", "cookie-notice", "comments-area", "top-nav x", "site-footer", "Share-Buttons", "ad_slot", "advertisement"):
        assert html.extract(f"<body><div class='{c}'>No</div><div id='{c}'>No</div><p>Text</p></body>", None) == "Text"


def test_long_items_are_found_by_any_part(spark):
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghij", k=r.randint(3, 8))) for _ in range(20_000)]
    text = lambda n: " ".join(words[int(len(words) ** r.random()) - 1] for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate((20, 40, 70, 300, 500, 800, 1200, 2500))]
    rows = [(k, f"{text(r.randint(0, 90))} {t} {text(r.randint(0, 90))}") for k, t in items]
    rows += [(100 + k, text(r.randint(100, 2000))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(g.doc_id, g.item_id) for g in got} == {(k, k) for k, _ in items}
    assert all(g.common == 1 and g.answer == 1 for g in got)


def test_pages_of_any_depth_and_width(spark):
    deep = lambda n: "<div>" * n + "<nav>Menu</nav><script>var x=1</script><p>deep</p>"
    wide = lambda k: "<body>" + "".join(f"<div class='c{chr(97 + i % 26) * (1 + i // 26)}'><p>text {k} {i}</p></div>" for i in range(1500))
    rows = [(n, "x", deep(n)) for n in (250, 305, 400, 5000)] + [(-k, "http://w.example/", wide(k)) for k in (1, 2, 3)]
    got = {r.page_id: r.text for r in html.extract_pages(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert all(got[n] == "deep" for n in (250, 305, 400, 5000))
    assert all(got[-k] == "\n".join(f"text {k} {i}" for i in range(1500)) for k in (1, 2, 3))


def test_templates_are_counted_over_all_pages_of_a_layout(spark):
    """One host with two layouts, a block on most pages, and a notice of three wordings; against a plain count."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    rows, want = [], {}
    for k in range(90):
        text = [" ".join(word() for _ in range(20)) for _ in range(3)]
        body = "".join(f"<p>{t}</p>" for t in text)
        most = "<p>Get our app</p>" if k % 20 else ""
        turn = f"<p>Notice {k % 3}</p>"
        page = f"<body><div class='a9'>{most}{turn}<div class='body{k}'>{body}</div></div>" if k % 2 else f"<body><section><div class='post'>{turn}{body}{most}</div></section>"
        rows.append((k, "http://two.example/p", page))
        want[k] = "\n".join(text)
    df = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(5)
    assert {x.page_id: x.text for x in html.extract_pages(df).collect()} == want


def plain_match(a, b):
    """Simple tree matching by its recurrence over all pairs of children."""
    if a.path != b.path:
        return 0
    x, y = list(a.kids.values()), list(b.kids.values())
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain_match(x[i], y[j]))
    return best[-1][-1] + 1


def test_tree_matching_against_its_recurrence():
    r = random.Random(6)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1) if r.random() < 0.7 else 'x'}</{t}>" for t in r.sample(["div", "p", "b", "i", "span", "section"], r.randint(0, 5))) if depth else ""

    for _ in range(60):
        a, b = (html.slim_tree(html.parse(f"<body>{tree(4)}")) for _ in range(2))
        score, pairs = html.tree_match(a, b)
        assert score == plain_match(a, b) == len(pairs) and all(x.path == y.path for x, y in pairs)


def test_recall_of_rephrased_and_long_items(spark):
    """Items word for word, with three of ten words replaced, and of up to 20,000 words; other documents share only words."""
    r = random.Random(12)
    words = ["".join(r.choices("abcdefghij", k=r.randint(3, 8))) for _ in range(3000)]
    text = lambda n: " ".join(r.choices(words, k=n))
    items = [(k, text(r.randint(15, 60))) for k in range(40)] + [(100, text(3000)), (101, text(6000) + ". " + text(9)), (102, text(20_000))]
    rows, want = [], set()
    for share in (0, 0.3):
        for k, t in items:
            w = t.split()
            for i in r.sample(range(len(w)), int(share * len(w))):
                w[i] = r.choice(words)
            rows.append((len(rows), f"{text(r.randint(0, 90))} {' '.join(w)} {text(r.randint(0, 90))}"))
            want.add((len(rows) - 1, k))
    rows += [(1000 + k, text(r.randint(50, 500))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {(g.doc_id, g.item_id) for g in decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and {(n, k) for n, k in want if n < len(items) or k >= 100} <= got


def test_items_of_common_words_change_no_other(spark):
    r = random.Random(13)
    rare = ["".join(r.choices("klmnop", k=7)) for _ in range(2000)]
    rows = [(k, " ".join(r.choices(rare, k=30) + ["to be or not to be"])) for k in range(400)]
    docs = spark.createDataFrame([*rows, (500, "x " + " ".join(rare[:30]) + " y"), (501, "or to to be be or not not to be or to")], "doc_id bigint, text string").repartition(4)
    find = lambda items: {tuple(g)[:1] + tuple(g)[2:] for g in decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")).where("item_id = 1").collect()}
    item = (1, " ".join(rare[:30]))
    alone, beside = find([item]), find([item, (2, "or to to be be or not not to be or to")])
    assert {x[:2] + x[3:] for x in alone} == {x[:2] + x[3:] for x in beside} and {x[0] for x in alone} == {500}
    both = decontaminate.find_leaks(docs, spark.createDataFrame([item, (2, "or to to be be or not not to be or to")], "item_id bigint, text string")).where("item_id = 2").collect()
    assert 501 in {g.doc_id for g in both}
