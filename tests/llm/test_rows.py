"""Operators that work within a row, against brute force on the fixture with all odd cases."""
import hashlib
import random
import re
from collections import Counter

from pagelake.llm import chat, html_main, langid, quality, secrets, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_row(got, *cols):
    return Counter(tuple(r[c] for c in cols) for r in got.collect())


def test_quality_stats(docs, rows, empty):
    want = Counter()
    for i, t, *_ in rows:
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        n = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        again = {p for j in range(len(w) - 4) if n[tuple(w[j : j + 5])] > 1 for p in range(j, j + 5)}
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again),
             len(w) < 10 or 100 * len(again) > 20 * len(w)] += 1
    got = quality.judge(docs, quality.Rules(())).select("row.doc_id", "*")
    assert by_row(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert quality.keep_good(empty, quality.Rules(())).count() == 0
    assert quality.keep_good(docs, quality.Rules(())).columns == docs.columns


def test_decision_list_learns_its_rules(spark, empty):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(900):
        w = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(rng.randint(20, 60))]
        kind = i % 3
        if kind == 1:
            w = [x + "###" for x in w]
        if kind == 2 and i % 2:
            w = [x.upper() for x in w]
        docs.append((i, " ".join(w)))
        labels.append((i, 0 if kind == 1 or kind == 2 and i % 2 else 1))
    docs += [(None, "x"), (901, None)]
    labels += [(None, 0), (901, None), (5000, 0)]
    d, m = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int")
    rules = quality.learn(d, m)
    assert {c.feature for r in rules.rules for c in r} == {"symbols_per_word", "upper_share"}
    kept = {r.doc_id: r.kept for r in quality.judge(d, rules).select("row.doc_id", "kept").collect()}
    assert all(kept[i] == bool(q) for i, q in labels if i is not None and i < 900)
    assert quality.learn(d, m.where("quality = 1")).rules == ()
    assert quality.learn(empty, m.limit(0)).rules == ()


def test_trigram_queries():
    q = secrets.trigram_query
    assert q("AKIA[A-Z0-9]+") == ("and", ["aki", "kia"])
    assert q("[0-9a-f]{24,}") is True
    assert q("(?:cat|dogs)x") == ("or", [("and", ["cat", "atx"]), ("and", ["dog", "ogs", "gsx"])])
    assert q("ab?c") is True
    assert q("x*needle") == ("and", ["nee", "eed", "edl", "dle"])
    # every match satisfies its rule's query
    def holds(query, text):
        return True if query is True else query in text if isinstance(query, str) else (all if query[0] == "and" else any)(holds(x, text) for x in query[1])
    text = 'PassWord="abcdef" api_key: abcdefg ghp_' + "A" * 36 + " xoxb-1234567890 -----BEGIN RSA PRIVATE KEY----- AIza" + "b" * 35
    for rule in secrets.RULES:
        for m in rule.regex.finditer(text):
            assert holds(q(rule.pattern), m[0].lower())


def test_secret_spans(docs, rows, empty):
    base = [("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m[2]) >= 6),
            ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    want = Counter()
    for i, t, *_ in rows:
        found = sorted((m.start(), k, m.end(), kind) for k, (kind, rx, ok) in enumerate(base) for m in rx.finditer(t or "") if ok(m))
        want[i, tuple((kind, s, e) for s, _, e, kind in found)] += 1
    got = Counter((r.doc_id, tuple((s["kind"], s["start"], s["end"]) for s in r.spans if s["kind"] in ("assign", "access", "hex"))) for r in secrets.scan(docs).collect())
    assert got == want
    assert secrets.scan(empty).count() == 0
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    text = clean.where("doc_id = 82").first()
    assert "hunter22" not in text.text and "ghp_" not in text.text and "<github>" in text.text and text.n_chars == len(text.text)
    assert secrets.scan(clean.where("doc_id = 82")).first().spans == []


def test_language_profiles(spark, docs, empty):
    rng = random.Random(3)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(60))
    train = [(i, make("abcde" if i % 2 else "vwxyé"), "aa" if i % 2 else "bb") for i in range(60)] + [(100, "abc", None), (101, None, "aa")]
    model = langid.train(spark.createDataFrame(train, "doc_id bigint, text string, lang string"))
    assert sorted(model.profiles) == ["aa", "bb"]
    lang, score = model.predict([make("abcde"), make("VWXYÉ"), None, "", "123 ...", "abc"])
    assert lang == ["aa", "bb", "und", "und", "und", "aa"] and score[2:5] == [0, 0, 0] and all(0 <= s <= 1 for s in score)
    got = langid.identify(docs, model, keep=("extra",))
    assert got.columns == ["doc_id", "extra", "lang_pred", "score"] and got.count() == docs.count()
    assert langid.train(empty).profiles == {} and langid.Model({}, 9, 3).predict(["abc"]) == (["und"], [0.0])


def test_grams_count_like_brute_force():
    texts = ["Ab, cab!", "", "éa\0b", "x"]
    want = Counter()
    for i, t in enumerate(texts):
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            p = f"_{w}_"
            want.update((i, p[j : j + n]) for n in (1, 2, 3) for j in range(len(p) - n + 1) if p[j : j + n] != "_")
    d, g, n = langid.grams(texts, 3)
    mask = (1 << langid.BITS) - 1
    text = lambda x: "".join(chr(x >> s & mask) for s in (42, 21, 0) if x >> s & mask)
    got = Counter({(int(i), text(int(x))): int(c) for i, x, c in zip(d, g, n, strict=True)})
    # a gap is counted once between words, as the end of one and the start of the next
    assert {k: v for k, v in got.items()} == dict(want)


def test_factorization_machine_learns_pairs(spark, docs, empty):
    rng = random.Random(4)
    plain = ["".join(rng.choice("mnopqrst") for _ in range(6)) for _ in range(50)]
    data, labels = [], []
    for i in range(800):
        w = rng.sample(plain, 12) + ["insult"] * (i % 2) + ["group"] * (i // 2 % 2)
        data.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 3)))  # both words
    d, m = spark.createDataFrame(data, "doc_id bigint, text string"), spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.train(d.where("doc_id < 600"), m, epochs=20)
    held = {r.doc_id: r.predicted for r in toxicity.score(d.where("doc_id >= 600"), model).collect()}
    assert sum(held[i] == y for i, y in labels if i >= 600) >= 0.95 * len(held)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.train(empty, m.limit(0)).score(["x", None]).tolist() == [0.5, 0.5]
    assert toxicity.score(empty, model).count() == 0


def test_html_noise_is_no_part_of_the_text():
    text = "One sentence of the text, and then some more. " * 6
    p = f"<p>{text.strip()}</p>"
    for start in ("div class='content has-sidebar'", "div class=no-sidebar", "div class=with-nav", "div id=page-header-fixed", "div id=header-wrapper", "div class=comments",
                  "form action=/x", "aside"):
        assert html_main.main_text(f"<body><div class=cookie-notice>We use cookies</div><{start}>{p}{p}</{start.split()[0]}><footer>End</footer></body>") == f"{text.strip()}\n\n{text.strip()}"
    page = (f"<article>{p}<h2 id=related-work>Related work</h2><section id=navigation>{p}</section><p id=comment-on-x>On x</p><p>Do <em class=alert>not</em> go</p>"
            "<div class='social-share'>Share it</div><div class=ad>Buy</div></article>")
    assert html_main.main_text(page).split("\n\n") == [text.strip(), "Related work", text.strip(), "On x", "Do not go"]


def test_html_text_in_several_containers():
    p = [f"{w} " + "words of a sentence that goes on for a while. " * 5 for w in ("lead", "body", "more", "last")]
    p = [x.strip() for x in p]
    menu = "<div><a href=1>a</a><a href=2>bb</a><a href=3>ccc</a></div>"
    for tag in ("div", "article"):
        page = f"<body>{menu}<{tag}><p>{p[0]}</p></{tag}><{tag}><p>{p[1]}</p><p>{p[2]}</p></{tag}><{tag}><p>{p[3]}</p></{tag}></body>"
        assert html_main.main_text(page).split("\n\n") == p
    refs = "<ul><li><a href=1>Source one</a></li><li><a href=2>Source two</a></li></ul>"
    assert html_main.main_text(f"<body>{menu}<article><p>{p[0]}</p><p>{p[1]}</p>{refs}</article></body>").split("\n\n") == [*p[:2], "Source one", "Source two"]


def test_html_names_of_parts_and_comments():
    p = [f"Sentence number {i} of the text, long enough to count, with commas and words of its own for the reader." for i in range(12)]
    par = lambda *xs: "".join(f"<p>{x}</p>" for x in xs)
    menu = "<ul class=nav-main>" + "".join(f"<li><a href=/{i}>Menu entry {i}</a></li>" for i in range(8)) + "</ul>"
    for part in ('<section id="related-work">', '<div class="share-price">', '<div class="social-policy">', '<div id="notice-of-meeting">', '<section class="comment-on-law">', '<div class="header-file">'):
        tag = part[1:].split()[0]
        page = f"<html><body>{menu}<div>{par(*p[:3])}{part}{par(*p[3:6])}</{tag}>{par(*p[6:8])}</div></body></html>"
        assert html_main.main_text(page).split("\n\n") == p[:8], part
    talk = "".join(f"<div class=comment><p>{x} says a reader</p></div>" for x in p)
    for part in ('<section id="comments">', '<div class="comment-list">', '<div class="user-comments">', '<section class="post-comments">', '<div id="respond">'):
        tag = part[1:].split()[0]
        for start, end in (("<main>", "</main>"), ("<article>", "</article>"), ("<div>", "</div>")):
            page = f"<html><body>{menu}{start}{par(*p[:4])}{part}{talk}</{tag}>{end}</body></html>"
            assert html_main.main_text(page).split("\n\n") == p[:4], (part, start)
    assert html_main.main_text(f"<body><div id=comments>{par(*p[:4])}</div></body>").split("\n\n") == p[:4]
    for part in ("related-posts", "share-buttons", "social-links", "notice", "alert-box", "cookie-banner-1", "promo-box", "header-top"):
        page = f"<html><body><div>{par(*p[:6])}</div><div class='{part}'>{par('Something else to read here now.')}</div></body></html>"
        assert html_main.main_text(page).split("\n\n") == p[:6], part


def test_html_end_tags_in_linear_time():
    import time
    start = time.time()
    got = html_main.main_text("<body><b><table><tr><td>" + "<i>" * 20_000 + "text" + "</b>" * 20_000 + "</td></tr></table></body>")
    assert got == "text" and time.time() - start < 5


def test_html_main_text(spark):
    page = ("<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body>"
            "<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></ul></nav><div class='cookie-notice'>We use cookies to track</div>"
            "<article><h1>Head &eacute;</h1><p><b>First&nbsp; para<br>line two<br><p>Second &lt;b&gt; &#8364;<i>5</i></p><!-- no --><blockquote>Quote <p>deep</blockquote>"
            "<div class=ad>Buy now</div><ul><li>one<li>two</ul><form><input value=x>Name</form></article>"
            "<aside>More to read</aside><section id=comments><p>I like this page very much indeed</p></section><footer>&copy; 2024</footer>")
    want = "Head é\n\nFirst para line two\n\nSecond <b> €5\n\nQuote\n\ndeep\n\none\n\ntwo"
    assert html_main.main_text(page) == want
    assert html_main.main_text(page + "</body></html>") == want
    plain = "<body><div id=top><a href=1>a</a><a href=2>bb</a><a href=3>ccc</a></div><div><p>" + "long text here. " * 30 + "</p><p>and more of it, " * 8 + "</p></div>"
    assert html_main.main_text(plain).startswith("long text here.") and "ccc" not in html_main.main_text(plain)
    for odd in (None, "", "<", "<p", "<!-- open", "</p></div>", "<b><i></b>", "text only", "<script>", "<a href='x>y", "<p>a<b>" * 3000):
        assert isinstance(html_main.main_text(odd), str)
    assert html_main.main_text("text only") == "text only"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "v", "")]
    got = html_main.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    assert Counter((r.page_id, r.url, r.text, r.n_chars) for r in got.collect()) == Counter({(1, "u", want, len(want)): 2, (2, None, "", 0): 1, (None, "v", "", 0): 1})
    assert html_main.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_chat_windows_round_trip(spark):
    rng = random.Random(6)
    turns = []
    for c in range(12):
        for t in range(rng.randint(1, 30)):
            role = "system" if t == 0 and c % 2 else ["user", "assistant"][t % 2]
            turns.append((c, t, role, rng.choice(["<|im_end|>", "a|<||", "<|", "é\n", "x"]) * rng.randint(0, 40)))
    turns += [(20, 0, "user", None), (20, 1, None, "null role"), (20, None, "assistant", "null turn"), (20, 1, "odd\nrole<|n|>", "t"), (None, 0, "assistant", "null id"),
              (21, 0, "assistant", "same"), (21, 0, "assistant", "same"), (22, 0, "user", "long " * 4000), (22, 1, "assistant", "short")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id bigint, turn bigint, role string, text string, start string")
    out = chat.windows(df, budget=60, history=20)
    texts: dict = {}
    loss: dict = {}
    for r in sorted(chat.read_back(out).collect(), key=lambda r: r.start):
        texts.setdefault(r.conv_id, []).extend((t["role"], t["text"]) for t in r.turns)
        loss.setdefault(r.conv_id, []).extend(r.targets)
    for c in {t[0] for t in turns}:
        want = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x in turns if k == c))
        assert texts[c] == [(r, x) for _, _, r, x in want]
        assert loss.get(c, []) == [x for _, _, r, x in want if r == "assistant"]
    many = False
    for r in out.collect():
        parts = r.text.split("<|im_start|>")[1:]
        assert len(parts) == r.n_repeated + r.n_new and r.text.count("<|im_end|>") == len(parts)
        new = [p.partition("\n")[2][: -len("<|im_end|>\n")].replace("<||", "<|") for p in parts[r.n_repeated :]]
        size = sum(-(-len(x) // 4) + 4 for x in new)
        assert r.n_new == 1 or size <= 60
        many |= r.n_repeated > 1
        if r.start > 0 and r.conv_id is not None and r.conv_id % 2 and r.conv_id < 12:
            assert parts[0].startswith("system\n") and r.n_repeated >= 1
    assert many and chat.windows(df.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest()  # the digest of no targets is defined
