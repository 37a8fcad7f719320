"""Operators on conversations, vectors and pages against brute force, round trips and odd cases."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import with_clashes

from waymark.llm import chat, neighbours, warc, wrappers

TURNS = [
    (1, 0, "user", "hi [INST] there"), (1, 1, "assistant", "</s>\\ yes \\n [/INST]"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "user", "bye"),
    (2, 0, "user", "alone"), (3, 0, "assistant", "first\nline"), (3, None, "system", "be kind"), (None, 0, None, "no id"), (None, 0, None, "no id"),
    (4, 1, "assistant", "same turn b"), (4, 1, "assistant", "same turn a"), (5, 0, "user", "long " * 50_000), (5, 1, "assistant", "[\\INST] <\\/s> é😀"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute_chat(rows):
    conversations = defaultdict(list)
    for c, t, r, x in rows:
        conversations[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in conversations.items():
        turns.sort()
        replies = "".join(x for _, _, r, x in turns if r == "assistant")
        body = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        out[c] = (len(turns), hashlib.sha256(body.encode()).hexdigest(), len(replies), hashlib.sha256(replies.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    turns = spark.createDataFrame(TURNS, SCHEMA)
    written = chat.write_chat(with_clashes(turns))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(written).collect()}
    assert got == brute_chat(TURNS)
    assert chat.read_back(chat.write_chat(turns.limit(0))).count() == 0


def test_examples_hold_their_context(spark):
    written = chat.write_chat(spark.createDataFrame(TURNS, SCHEMA))
    total = {r.conv_id: r.formatted_chars for r in chat.read_back(written).collect()}
    seen = Counter()
    for e in chat.example_texts(written).collect():
        seen[e.conv_id] += len(e.text)
        assert e.text[:e.loss_start].endswith("[INST]assistant[/INST]") and e.text[e.loss_end:] == "</s>"
        assert e.text.count("[INST]") == e.place == e.text.count("</s>") == e.text.count("[/INST]")
    assert {c: n for c, n in total.items() if n} == dict(seen)


def test_examples_are_written_out(spark):
    """Every example is in the written rows with its whole context, in pieces where it is long; escapes may be cut by them."""
    long = [(7, i, "assistant" if i % 2 else "user", "\\" * (chat.PIECE // 2 - 20 + i) + "</s>[INST]" * (40 * i) + "é😀") for i in range(7)]
    rows = TURNS + long + [(8, i, "assistant", f"{i} ") for i in range(2100)]
    written = chat.write_chat(spark.createDataFrame(rows, SCHEMA))
    texts = {}
    for r in sorted(written.collect(), key=lambda r: r.piece):
        assert r.start == len(texts.setdefault((r.conv_id, r.place), "")) and 0 < len(r.text) <= 2 * chat.PIECE
        texts[r.conv_id, r.place] += r.text
    turns = {}
    for c, t, r, x in sorted(rows, key=lambda v: (v[0] is None, v[0] or 0, v[1] is not None, v[1] or 0, v[2] or "", v[3] or "")):
        turns.setdefault(c, []).append((r or "", x or ""))
    expected = {(c, n + 1) for c, all_ in turns.items() for n, (r, _) in enumerate(all_) if r == "assistant" or n + 1 == len(all_)}
    assert set(texts) == expected
    for (c, place), text in texts.items():
        if c != 8 or place % 100 == 0:
            assert [chat.read_turn(m[0]) for m in chat._TURN.finditer(text)] == turns[c][:place]
    got = {r.conv_id: r for r in chat.read_back(written).collect()}
    assert {c: tuple(r)[1:5] for c, r in got.items()} == brute_chat(rows)
    assert all(r.formatted_chars == sum(len(t) for (i, p), t in texts.items() if i == c and turns[c][p - 1][0] == "assistant") for c, r in got.items())


def exact(vectors, k):
    out = {}
    for i, q in vectors:
        if i is not None and i % 50 == 0 and usable(q):
            a = np.array(q, float)
            scores = [(-neighbours.cosine(np.array([v], float), a)[0], j) for j, v in vectors if j is not None and j != i and usable(v) and len(v) == len(q)]
            out[i] = [(j, -s) for s, j in sorted(scores)[:k]]
    return out


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(3)
    centres = draw.standard_normal((12, 32))
    rows = [(i, (centres[i % 12] + 0.4 * draw.standard_normal(32)).tolist()) for i in range(600)]
    rows += [(600 + i, list(rows[50][1])) for i in range(8)]  # ties
    rows += [(700, None), (701, []), (702, [0.0] * 32), (703, [None] + [1.0] * 31), (704, [float("nan")] * 32), (705, [float("inf")] * 32), (750, [0.0] * 32)]
    rows += [(800, [1.0, 2.0]), (801, [2.0, 4.0]), (802, [1.0, -1.0]), (None, [1.0, 1.0]), (850, [3.0])]
    return rows


def test_neighbours(spark, vectors):
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in neighbours.search(neighbours.build_index(with_clashes(frame)), frame.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(found[r.query_id])
    want = exact(vectors, 5)
    assert set(found) == {q for q in want if want[q]}
    hits = sum(len({j for j, _ in found[q]} & {j for j, _ in want[q]}) for q in found)
    assert hits >= 0.99 * sum(len(want[q]) for q in found)
    assert found[50] == want[50] and [j for j, _ in found[800]] == [801, 802]
    empty = frame.limit(0)
    assert neighbours.search(neighbours.build_index(empty), frame).count() == 0
    assert neighbours.search(neighbours.build_index(frame), empty).count() == 0


def test_error_bound_holds():
    draw = np.random.default_rng(4)
    v = draw.standard_normal((500, 48))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    codes, scalars = neighbours.encode(v)
    q = draw.standard_normal(48)
    q /= np.linalg.norm(q)
    corners = (np.unpackbits(codes, axis=1, count=48) * 2.0 - 1) / np.sqrt(48)
    error = np.abs(corners @ (q @ neighbours.rotation(48)) / scalars - v @ q)
    bound = np.sqrt(1 - scalars ** 2) / scalars / np.sqrt(47)
    assert (error <= 3 * bound).mean() > 0.99 and (error <= bound).mean() > 0.5


PAGES = [(i, f"http://www.Site{i % 3}.org:80/p/{i % 4}?q={i}", f"<p>page {i % 7} é</p>") for i in range(60)]
PAGES += [(70, None, None), (71, "not a url", ""), (72, "http://[bad", None), (None, "http://x.org", "<p>page 1 é</p>"), (5, "http://y.org/a\nb", "<p>page 5 é</p>"), (80, "http://x.org/", "z" * 300_000)]
PAGES += [(90, "http://r.org/", "repeated"), (90, "http://r.org/", "repeated"), (90, "http://r.org/", "repeated")]


@pytest.mark.parametrize("min_bytes", [0, 16])
def test_archives(spark, monkeypatch, min_bytes):
    monkeypatch.setattr(warc, "RUN", 7)
    pages = with_clashes(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    index = warc.merge_runs(warc.write_archives(pages, min_bytes=min_bytes), rows_per_range=20)
    rows = warc.read_archives(index).collect()
    payloads = defaultdict(list)
    for i, _, h in PAGES:
        payloads[(h or "").encode()].append(i)
    want = Counter()
    for payload, ids in payloads.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        ids.sort(key=lambda i: (i is None, i or 0))
        for n, i in enumerate(ids):
            revisit = n > 0 and len(payload) >= min_bytes
            want[(i, len(payload), digest, "revisit" if revisit else "response", ids[0] if revisit else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == want
    order = [(r.urlkey.encode(), r.captured, r.page_id is None, r.page_id or 0) for r in index.orderBy("range", "position").collect()]
    assert order == sorted(order) and len(order) == len(PAGES)


def test_empty_archive(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.merge_runs(warc.write_archives(pages))).count() == 0


def test_loser_tree():
    draw = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(((f"u{draw.randint(0, 9)}", str(draw.randint(0, 9)), draw.randint(0, 99), "", "", "f", n, 0) for n in range(draw.randint(0, 12))), key=warc._key) for _ in range(k)]
        assert [warc._key(e) for e in warc.LoserTree(runs)] == sorted(warc._key(e) for r in runs for e in r)


def test_url_keys():
    assert warc.url_key("https://WWW.Example.com/A?b#c") == "com,example)/a?b"
    assert warc.url_key(None) == "" and warc.url_key("http://h.org:8080") == "org,h:8080)/"


FRAME = ("<!DOCTYPE html><html><head><title>T</title><style>p > a {{}}</style></head><body><header>Site name</header><nav><ul><li><a href='/'>Home</a><li>About</ul></nav>"
         "<div id='cookie-notice'>We use cookies</div>{0}<aside>Related</aside><div class='comments'><p>A reader says</p></div><form><input>Send</form><footer>&copy; us</footer></body></html>")


def page(parts, container="article"):
    body = "".join(f"<p>{p}</p>" for p in parts)
    return FRAME.format(f"<{container}><h1>Head {len(parts)}</h1>{body}</{container.split()[0]}>")


@pytest.mark.parametrize("container", ["article", "main", "div class='story'", "section"])
def test_main_text(spark, container):
    pages, want = [], {}
    for i in range(12):
        parts = [f"Part {i}.{k} &amp; more <b>words</b> that go\n on &lt;here&gt;, {'long ' * 10}" for k in range(1 + i % 4)]
        pages.append((i, f"http://h{i % 2}.org/{i}", page(parts, container)))
        clean = [" ".join(p.replace("<b>", "").replace("</b>", "").replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">").split()) for p in parts]
        want[i] = "\n".join([f"Head {len(parts)}", *clean])
    rows = wrappers.extract(with_clashes(spark.createDataFrame(pages, "page_id long, url string, html string"))).collect()
    assert {r.page_id: r.text for r in rows} == want
    assert all(r.n_chars == len(r.text) for r in rows)


def test_deep_and_irregular_pages_take_linear_time():
    import json
    import time
    deep = "<article>" + "<div>" * 20_000 + "core" + "</div>" * 20_000 + "<p>end</p></article>"
    mixed = "<article>" + "".join(f"<{random.choice(['p', 'h2', 'li', 'dd'])} class=c{'abcdefghij'[i % 10] * (i % 97)}>t{i}" for i in range(20_000)) + "</article>"
    start = time.time()
    wrapper = json.dumps(wrappers._dump(wrappers.infer([deep, mixed, mixed[::-1], deep])))
    assert wrappers.main_text(deep, wrapper) == "core\nend"
    assert wrappers.main_text(mixed, wrapper) == "\n".join(f"t{i}" for i in range(20_000))
    assert time.time() - start < 20


def test_odd_pages(spark):
    odd = [(1, None, None), (2, "http://a.org", ""), (3, "http://a.org", "just text"), (4, "http://b.org", "<article><p>open <b>tags<p>two<script>var a='</p>';</script>"),
           (5, "http://c.org", "<div><p>only page " + "x" * 200_000 + "</p></div>"), (6, "http://d.org", "<nav>menu</nav><!-- <article>no</article> -->"),
           (4, "http://b.org", "<article><p>open <b>tags<p>two<script>var a='</p>';</script>"), (None, "http://e.org", "<main>a<br>b &nbsp; c</main>")]
    rows = wrappers.extract(spark.createDataFrame(odd, "page_id long, url string, html string")).collect()
    got = Counter((r.page_id, r.text if len(r.text) < 100 else len(r.text)) for r in rows)
    assert got == Counter([(1, ""), (2, ""), (3, "just text"), (4, "open tags\ntwo"), (4, "open tags\ntwo"), (5, 200_010), (6, ""), (None, "a b c")])
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def text_by_host_form(pages):
    import json
    form = json.dumps(wrappers._dump(wrappers.infer(pages)))
    return [wrappers.main_text(p, form) for p in pages]


def test_every_page_of_a_host_counts(spark):
    """One host: articles of ever new classes, pages without one, and one page of its own kind."""
    rows, want = [], {}
    for i in range(40):
        word = "".join(chr(97 + int(d)) for d in str(i))
        story = f"Story {i} goes on. " * 5
        if i == 17:
            html, want[i] = f"<body class='front'><header>Site</header><section id=x><h2>Only here</h2><p>{story}</p></section></body>", f"Only here\n{story.strip()}"
        elif i % 4 == 1:
            html, want[i] = f"<body class='p-{word}'><nav>menu</nav><div class='story tag-{word}'><h1>Head {word}</h1><p>{story}<p>Next {i}</div><footer>us</footer></body>", f"Head {word}\n{story.strip()}\nNext {i}"
        else:
            html, want[i] = f"<body class='b-{word}'><nav>menu</nav><article class='post tag-{word}'><h1>Head {word}</h1><p>{story}</article></body>", f"Head {word}\n{story.strip()}"
        rows.append((i, "http://one.org/", html))
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    assert {r.page_id: r.text for r in got} == want


def test_fixed_text_repeats_over_different_pages():
    def story(i, extra=""):
        return f"<body><div class=story><div class=note>All rights kept</div><p>Story {i} goes on and on</p>{extra}</div></body>"

    pages = [story(i) for i in range(6)] + [story(6, "<blockquote>Said once</blockquote>"), story(7, "<div class=note>Another note</div>")]
    want = [f"Story {i} goes on and on" for i in range(6)] + ["Story 6 goes on and on\nSaid once", "Story 7 goes on and on\nAnother note"]
    assert text_by_host_form(pages) == want
    # copies of one page are one page, however many
    copies = [story("copied")] * 50 + [story("other")]
    assert text_by_host_form(copies) == [f"All rights kept\nStory {'other' if p is copies[-1] else 'copied'} goes on and on" for p in copies]
    # pages that differ in their furniture only keep their text
    assert text_by_host_form([f"<nav>{i}</nav><p>same story</p>" for i in range(9)]) == ["same story"] * 9


def test_streams_align_in_order():
    def brute(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    draw = random.Random(2)
    for _ in range(500):
        a, b = ([draw.choice("abcd") for _ in range(draw.randint(0, 12))] for _ in range(2))
        for bits in (1 << 28, 20, 1):
            met = wrappers.common(a, b, bits)
            assert len(met) == brute(a, b) and all(a[i] == b[j] for i, j in met)
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(met, met[1:]))
    a, b = ([draw.choice("abcd") for _ in range(20_000)] for _ in range(2))
    assert len(wrappers.common(a, b)) == len(wrappers.common(a, b, 1 << 24)) > 10_000
    # a plain div of teasers before a plain div of the story, and one of links after it
    pages = ["<body><div>" + "".join(f"<p>Teaser {i}.{k}</p>" for k in range(1 + i % 3)) + "</div><div>" + "".join(f"<p>Story {i}.{k} {'goes on ' * 20}</p>" for k in range(1 + i % 4))
             + f"</div><div><p>Link {i}</p></div></body>" for i in range(12)]
    assert text_by_host_form(pages) == ["\n".join(f"Story {i}.{k} {'goes on ' * 20}".strip() for k in range(1 + i % 4)) for i in range(12)]
    # parts of varying number stay together
    parts = ["<body>" + "".join(f"<div><h2>Part {i}.{k}</h2><p>{'words ' * 9}{i}.{k}</p></div>" for k in range(1 + i % 3)) + "</body>" for i in range(9)]
    assert text_by_host_form(parts) == ["\n".join(f"Part {i}.{k}\n{'words ' * 9}{i}.{k}" for k in range(1 + i % 3)) for i in range(9)]


def test_nesting_has_no_cap():
    import time
    start = time.time()
    for n in (200, 20_000):
        named = "<div id=page><article>" + "<div>" * n + "core" + "</div>" * n + "<p>rest</p></article><div>outside</div></div><footer>us</footer>"
        furniture = "<div id=page><article>" + "<div>" * n + "core<nav><div>menu</div></nav>" + "</div>" * n + "<p>rest</p></article></div>"
        plain = "<div id=page>" + "<section>" * n + "<ul><li>core<li>more</ul>" + "</section>" * n + "<p>rest</p></div>"
        assert text_by_host_form([named, furniture, plain]) == ["core\nrest", "core\nrest", "core\nmore\nrest"]
    assert time.time() - start < 20


def story_of(i):
    return f"Story {i} begins here. " + f"It goes on about {i} for long. " * 12


def same_host(body, n=6):
    return text_by_host_form([f"<html><head><title>t{i}</title></head><body>{body(i, story_of(i))}</body></html>" for i in range(n)])


def test_the_wrapper_decides_past_named_parts():
    told = [story_of(i).strip() for i in range(6)]
    cards = lambda i: "".join(f"<article><h3>Teaser {i}.{k}</h3><p>Read this {i}{k}</p></article>" for k in range(1 + i % 3))
    # a story in a div next to teasers that are articles
    assert same_host(lambda i, s: f"<div class=story><p>{s}</p></div><div class=cards>{cards(i)}</div>") == told
    # main, then more articles and comments that are articles, of any class
    assert same_host(lambda i, s: f"<main><p>{s}</p></main><div class=more>{cards(i)}</div><section class=discussion>"
                     + "".join(f"<article><p>I, reader {i}{k}, say so. {'So it is. ' * 9}</p></article>" for k in range(i)) + "</section>") == told
    # comments within the article itself
    assert same_host(lambda i, s: f"<article><h1>Head {i}</h1><p>{s}</p><section class=talk>" + "".join(f"<article>Reader {i}{k}</article>" for k in range(i)) + "</section></article>") == [
        f"Head {i}\n{t}" for i, t in enumerate(told)]
    # a page that lists its articles keeps them
    assert same_host(lambda i, s: f"<main><h1>All of {i}</h1><article><p>{s}</p></article><article><p>second {s}</p></article></main>") == [
        f"All of {i}\n{t}\nsecond {t}" for i, t in enumerate(told)]


def test_words_of_classes_empty_no_page():
    told = [story_of(i).strip() for i in range(6)]
    assert same_host(lambda i, s: f"<div class='content has-sidebar'><article><p>{s}</p></article></div>") == told
    assert same_host(lambda i, s: f"<div class='page with-sidebar no-header'><p>{s}</p></div>") == told
    assert same_host(lambda i, s: f"<div class='sidebar wrap'><div class=text><p>{s}</p></div><div class=widget><p>w {i}</p></div></div>") == told
    assert same_host(lambda i, s: f"<article><div class='entry-header'><h1>Head {i}</h1></div><p>{s}</p></article>") == [f"Head {i}\n{t}" for i, t in enumerate(told)]
    assert same_host(lambda i, s: f"<article><header><h1>Head {i}</h1></header><p>{s}</p><div class='share social'>Share {i}</div></article>") == [f"Head {i}\n{t}" for i, t in enumerate(told)]
    comments = lambda i: "".join(f"<p>{i}{k} is what I think. {'Truly. ' * 40}</p>" for k in range(5))
    assert same_host(lambda i, s: f"<div class=post><p>{s}</p></div><div id=comments>{comments(i)}</div>") == told


def test_a_host_of_mixed_layouts():
    def body(i, s):
        if i % 3 == 0:
            return f"<div class=wrap><article><p>{s}</p></article></div><div class=cards><p>see {i}</p></div>"
        if i % 3 == 1:
            return f"<main><section><p>{s}</p></section></main><div class=more><article>teaser {i}</article></div>"
        return f"<div class=plain><div><p>{s}</p></div></div>"

    assert same_host(body, 12) == [story_of(i).strip() for i in range(12)]


def test_slots_of_flow_bound_the_wrapper():
    """Headings and paragraphs in any order are one slot, so a host's wrapper does not grow with its pages."""
    draw = random.Random(9)
    pages = ["<article>" + "".join(f"<{draw.choice(['h2', 'p', 'ul', 'blockquote'])}>{i} {k}" for k in range(draw.randint(1, 40))) + "</article>" for i in range(60)]
    flats = [wrappers.skeleton(wrappers.parse(p))[1] for p in pages]
    merged = wrappers.wrapper_of(flats[0], frozenset(), frozenset())
    for flat in flats[1:]:
        merged = wrappers.merge(merged, wrappers.wrapper_of(flat, frozenset(), frozenset()))
    assert len(wrappers._flat(merged)) < 10


def test_wrapper_of_tiny_streams_by_brute_force():
    """The groups of a merged level are a shortest list that holds both levels in order."""
    def shortest(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                if not i or not j:
                    best[i][j] = i + j
                else:
                    best[i][j] = best[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else 1 + min(best[i - 1][j], best[i][j - 1])
        return best[-1][-1]

    def holds(long, short):
        it = iter(long)
        return all(x in it for x in short)

    draw = random.Random(3)
    for _ in range(200):
        levels = [[draw.choice(["div", "section", "table"]) for _ in range(draw.randint(0, 5))] for _ in range(2)]
        pages = ["".join(f"<{n}><form></form></{n}>" for n in level) for level in levels]
        a, b = ([name for name, _ in wrappers.level_of(wrappers.parse(p).kids, str)] for p in pages)
        x, y = (wrappers.wrapper_of(wrappers.skeleton(wrappers.parse(p))[1], frozenset(), frozenset()) for p in pages)
        merged = [g.name for g in wrappers.merge(x, y).groups]
        assert holds(merged, a) and holds(merged, b) and len(merged) == shortest(a, b)
