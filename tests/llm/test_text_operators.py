"""Token counts, packing, rules, decontamination, pages and urls against brute force."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tablelog.llm import decontaminate, html_extract, packing, quality_rules, token_counts, url_filter
from tablelog.llm.queries import BLOCKED_HOSTS, URL_RULES, tokenizer_path

from .conftest import WORDS, prose


@pytest.fixture(scope="module")
def byte_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def test_token_counts_are_the_librarys(edge, edge_rows, byte_bpe):
    got = sorted(map(tuple, token_counts.count_tokens(edge, tokenizer_path("byte_bpe_50k.json"), chunk=700, overlap=24).collect()), key=repr)
    want = []
    for r in edge_rows:
        t = r[1] or ""
        n = len(byte_bpe.encode(t, add_special_tokens=False).ids)
        want.append((r[0], len(t.encode()), n, n > 1024))
    assert got == sorted(want, key=repr)


def test_token_counts_of_nothing(empty):
    assert token_counts.count_tokens(empty, tokenizer_path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(200, 8), (1000, 64)])
def test_splicing_widens_until_it_aligns(byte_bpe, chunk, overlap):
    rng = random.Random(3)
    for text in (prose(rng, 900), "y" * 3000, "ab\n\n" * 800, prose(rng, 200).replace(" ", "") + " " + "z " * 900, "日本" * 900 + " x"):
        assert token_counts.spliced_count(byte_bpe, text, chunk, overlap) == len(byte_bpe.encode(text, add_special_tokens=False).ids)


def test_packing_is_an_exact_partition(edge, edge_rows, word_bpe):
    rows = packing.pack(edge, tokenizer_path("word_bpe_49k.json"), batch_tokens=5000).collect()
    ids = defaultdict(list)
    for r in edge_rows:
        ids[r[0]].append(np.array([*word_bpe.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4"))
    covered, windows = defaultdict(int), defaultdict(list)
    for r in rows:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        covered[r.doc_id] += r.length
        windows[r.sequence_id].append((r.offset, r.length))
    assert covered == {k: sum(map(len, v)) for k, v in ids.items()}
    padding = 0
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
        padding += 4096 - at if at & (at - 1) else 0
    assert padding <= 0.02 * sum(covered.values())


def test_packing_of_nothing(empty):
    assert packing.pack(empty, tokenizer_path("word_bpe_49k.json")).count() == 0


def test_tightest_room():
    rng = random.Random(1)
    rooms, held = packing.Rooms(64), []
    for k in range(3000):
        least = rng.randint(1, 64)
        want = min((r for r in held if r >= least), default=None)
        assert rooms.tightest(least) == want
        if want is not None and rng.random() < 0.6:
            rooms.take(want)
            held.remove(want)
        else:
            held.append(rng.randint(0, 64))
            rooms.put(held[-1], k)


def counts_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    places, covered = defaultdict(list), set()
    for k in range(len(words) - 7):
        places[tuple(words[k : k + 8])].append(k)
    for at in places.values():
        if len(at) > 1:
            covered |= {k + j for k in at for j in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_counts(edge, edge_rows):
    got = quality_rules.judge(edge, []).collect()
    want = sorted(((r[0], *counts_of(r[1])) for r in edge_rows), key=repr)
    assert sorted((tuple(r)[:6] for r in got), key=repr) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed)


def test_rules_keep_all_columns_of_what_they_keep(edge):
    kept = quality_rules.keep_good(edge, [])
    assert kept.columns == edge.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == sorted(r.doc_id if r.doc_id is not None else -1 for r in quality_rules.judge(edge, []).where("kept").collect())


def test_decision_list_finds_the_threshold():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(900), "b": rng.random(900)}
    bad = (x["a"] > 0.8) | ((x["b"] < 0.2) & (x["a"] < 0.3))
    part = np.arange(900) % 3 == 0
    rules = quality_rules.learn_list(x, bad, part)
    hit = np.zeros(900, bool)
    for r in rules:
        hit |= r.covers(x)
    assert (hit == bad).mean() > 0.97
    assert quality_rules.learn_list(x, np.zeros(900, bool), part) == []


def distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for k, c in enumerate(pattern, 1):
        new = [k]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row), row.index(min(row))


def test_myers_is_edit_distance():
    rng = random.Random(2)
    for _ in range(400):
        p = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 9)))
        t = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 14)))
        assert decontaminate.myers(p, t) == distance_in(p, t)


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        k = rng.randrange(len(out))
        rng.choice([lambda: out.__setitem__(k, "q"), lambda: out.pop(k), lambda: out.insert(k, "q")])()
    return "".join(out)


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    items = [(k, prose(rng, 12)) for k in range(6)] + [(6, ""), (7, None)]
    docs = []
    for k in range(30):
        item = items[k % 6][1]
        inside = ["", item, item.upper().replace(" ", "\n"), edited(rng, item, 2), edited(rng, item, 40)][k % 5]
        docs.append((k, prose(rng, 20) + " " + inside + " " + prose(rng, 10)))
    docs += [(30, None), (31, "")]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, text in docs:
        t = decontaminate.plain(text)
        for i, item in items:
            p = decontaminate.plain(item)
            if p:
                n, _ = distance_in(p, decontaminate.normalised(pa.array([text], pa.string()))[0].tobytes())
                if n <= int(len(p) * 0.08):
                    want[d, i] = n
        del t
    assert {k: r.distance for k, r in got.items()} == want and want
    for (d, i), r in got.items():
        inside = decontaminate.plain(docs[d][1].encode()[r.start : r.end].decode(errors="ignore"))
        assert distance_in(decontaminate.plain(items[i][1]), inside)[0] == r.distance


def test_items_short_null_and_of_any_type(spark):
    docs = [(0, "we concatenate a cat."), (1, "concatenate"), (2, "Cat"), (3, "a cat-like thing"), (4, "the thirteen lettrs"), (None, "cat"), (6, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for kind, key in (("int", 5), ("string", "five"), ("double", 5.0), ("long", None)):
        items = spark.createDataFrame([(key, "cat"), (key, "thirteen letters"[:15])], f"item_id {kind}, text string")
        got = {(r.doc_id, r.distance) for r in decontaminate.find_leaks(df, items).collect() if r.item_id == key}
        assert got == {(0, 0), (2, 0), (3, 0), (None, 0), (4, 1)}, kind  # whole words, and one edit in 15
        few = {(r.doc_id, r.distance) for r in decontaminate.find_leaks(df, items, most_bytes=4).collect()}
        assert few == got and decontaminate.keep_clean(df, items, most_bytes=4).count() == 2


def test_leaks_of_nothing(empty, edge, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert decontaminate.find_leaks(edge, none).count() == 0
    assert decontaminate.find_leaks(empty, some).count() == 0
    assert decontaminate.keep_clean(edge, none).count() == edge.count()
    assert decontaminate.keep_clean(edge, some).columns == edge.columns


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/">Home</a></li><li>News</li></ul></nav><div class="cookie-notice">We use cookies.</div><!-- x > y -->
<article><header><h1>Title &amp; more</h1></header><p>First   line<br>goes <b>on</b>.<p>Second, unclosed &eacute;.<div class="ad">Buy now!</div><p>Third.</p><form><input>Name</form></article>
<aside>Related</aside><section id="comments"><p>Nice post, thanks.</p></section><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "Title & more\n\nFirst line goes on.\n\nSecond, unclosed é.\n\nThird."
    plain = "<body><ul><li>a</li><li>b</li></ul><div><p>A long sentence, with a comma, stands here for real.</p><p>Another one, also long enough; it ends.</p></div></body>"
    assert html_extract.main_text(plain).count("\n\n") == 1
    for odd in (None, "", "<", "<p", "<!--", "<script>", "<p><p><p>", "</div></p>", "<nav>only</nav>"):
        assert isinstance(html_extract.main_text(odd), str)


def test_ratios_decide_beside_an_article():
    body = "".join(f"<p>Paragraph {k} of the body, which is long enough to count, says {k} things; then it ends.</p>" for k in range(6))
    for other in ("<article><h3>More to read</h3></article>", "<article>Nice post.</article>"):
        assert "Paragraph 5" in html_extract.main_text(f'<body><div class="content">{body}</div><div>{other}</div></body>')
    low = f"<body><article>{body}<ul><li>a</li><li>b</li><li>c</li></ul><ul><li><ol><li>d</li></ol></li></ul></article></body>"
    assert "\n\nd" not in html_extract.main_text(low)  # the ratio also counts inside


@pytest.mark.parametrize("wrapper", ["div class='layout has-sidebar'", "div id='content-sidebar-wrap'", "section class='post share-enabled'", "div class='sidebar'", "div class=modal", "div class='related'"])
def test_wrappers_do_not_empty_a_page(wrapper):
    tag = wrapper.split()[0]
    page = f"<body><{wrapper}><article><h1>Title</h1><p>The text, whole.</p><div class='ad'>Buy now!</div></article></{tag}><footer>us</footer></body>"
    assert html_extract.main_text(page) == "Title\n\nThe text, whole."
    long = "A sentence of the page, with a comma. " * 8
    assert html_extract.main_text(f"<body><{wrapper}><p>{long}</p></{tag}></body>") == long.strip()


def test_marks_that_hold():
    body = "<article><h1>Title</h1><p>The text, whole.</p></article>"
    long = "A remark, of some length. " * 12
    for other in (f"<div class='cookie-notice'>{long}</div>", f"<section id=comments><article>{long}</article></section>", f"<div class='widget'><aside>{long}</aside></div>", "<div class='site-footer'>us</div>", "<ul class='comment-list'><li>Nice.</li></ul>", f"<div class=widget hidden><p>{long}</p></div>"):
        assert html_extract.main_text(f"<body>{body}{other}</body>") == "Title\n\nThe text, whole."
    assert html_extract.main_text("<body><div class='widget'><article><p>The text, whole.</p><div class='share'>Tell</div></article></div></body>") == "The text, whole."


def test_pages_table(spark):
    rows = [(1, "u", PAGE, 1), (None, None, None, 2), (2, "v", "", 3), (1, "u", PAGE, 1)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert sorted((r.n_chars for r in got)) == [0, 0, 64, 64] or all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def judged(url):
    at = url.find("://") if url else -1
    rest = url[at + 3 :] if at >= 0 else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = []
    for rule, verdict in URL_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    blocked = any((host == b[:-1] or host.endswith("." + b[:-1])) and path.startswith("/") for b in BLOCKED_HOSTS)
    return host, path, None, "block" if blocked else "allow"


def test_urls_against_brute_force(spark):
    rng = random.Random(6)
    hosts = ["example.org", "A.Example.ORG", "x.com", "com", "spam-farm.example.net", "w.spam-farm.example.net", "notexample.org", "example.org:80", "", "a..org", "org."]
    urls = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(['', '/', '/es/', '/en/1', '/en/12/x', '/fr/a', '/de/b', '/es'])}{rng.choice(['', '?q=/de/', '#x'])}" for _ in range(400)] + [None, "", "no scheme", "mailto:a@b", "http://"]
    rows = [(k, u, "clash") for k, u in enumerate(urls)] + [(None, urls[0], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    for most in (1 << 20, 60):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, URL_RULES, BLOCKED_HOSTS, most_bytes=most).collect()}
        assert got == {k: judged(u) for k, u, _ in rows}
    assert url_filter.judge_urls(df.limit(0), URL_RULES).count() == 0


def test_colliding_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: 7)
    path = tmp_path / "index"
    path.write_bytes(url_filter.build_index([("a.com/", "block"), ("b.com/", "allow")]))
    assert url_filter.Index(str(path)).judge([("b.com", "/x"), ("a.com", "/"), ("c.com", "/")]) == [("b.com/", "allow"), ("a.com/", "block"), (None, "allow")]


assert WORDS


def test_ratios_decide_on_pages_without_article():
    """Against a plain table of paths: mean length and punctuation, smoothed, fused, one threshold."""
    rng = random.Random(31)
    kept_some = dropped_some = 0
    for _ in range(60):
        made = []  # (path, text)
        body = []
        for k in range(rng.randint(2, 7)):
            outer = rng.choice(["div", "section", "table/tbody/tr/td", "center"])
            inner = rng.choice(["p", "div", "blockquote", "ul/li"])
            words = rng.choice([2, 3, 40, 90])
            tags = [*outer.split("/"), *inner.split("/")]
            part = "".join(f"<{x}>" for x in tags[:-1])
            for _ in range(rng.randint(1, 4)):
                text = prose(rng, words) + rng.choice(["", ".", ", and."])
                made.append(("/".join(["html", "body", *tags]), text))
                part += f"<{tags[-1]}>{text}</{tags[-1]}>"
            body.append(part + "".join(f"</{x}>" for x in reversed(tags[:-1])))
        paths = list(dict.fromkeys(p for p, _ in made))
        table = []
        for p in paths:
            own = [x for q, x in made if q == p]
            table.append((sum(map(len, own)) / len(own), sum(len(re.findall(r"[.,;:!?]", x)) for x in own) / len(own)))
        smooth = []
        for k in range(len(paths)):
            near = [table[max(k - 1, 0)], table[k], table[k], table[min(k + 1, len(paths) - 1)]]
            smooth.append((sum(x for x, _ in near) / 4, sum(y for _, y in near) / 4))
        most, dots = max(x for x, _ in smooth), max(y for _, y in smooth)
        keep = {p for p, (x, y) in zip(paths, smooth) if (x / most + (y / dots if dots else x / most)) / 2 * 0.999 >= 0.35}
        want = "\n\n".join(x for p, x in made if p in keep)
        assert html_extract.main_text("<html><body>" + "".join(body) + "</body></html>") == want
        kept_some += bool(keep)
        dropped_some += len(keep) < len(paths)
    assert kept_some == 60 and dropped_some > 20


def test_pages_of_odd_letters_and_great_depth():
    odd = "\u0130" * 12
    assert html_extract.main_text(f"<article><p>{odd}</p><script>var x=1;</SCRIPT ><p>after the script</p></article>") == f"{odd}\n\nafter the script"
    assert len(html_extract.main_text("<article>" + "<div>deep" * 20000 + "</b></span></li><li>" * 2000)) == 20000 * 6 - 2
    assert html_extract.main_text('<article><p>One.</p><div class="share-price">Shares rose 4 %.</div></article>') == "One.\n\nShares rose 4 %."


def test_many_parts_of_a_large_list(spark):
    hosts = [f"n{k}.ads.example.net/" for k in range(5000)]
    urls = ["http://n17.ads.example.net/x", "http://a.n4999.ads.example.net/", "http://n5000.ads.example.net/", "http://n17.ads.example.net", "http://n1.ads.example.org/en/1", None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    for most in (64 << 20, 20_000):  # in one index, and in more than a dozen
        got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(df, URL_RULES, hosts, most_bytes=most).collect()}
        assert got == {0: (None, "block"), 1: (None, "block"), 2: (None, "allow"), 3: (None, "allow"), 4: ("example.org/en/1", "block"), 5: (None, "allow")}
