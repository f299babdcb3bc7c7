"""Corpus operators against brute force on small tables with the awkward cases in them."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from panelspan.llm import (
    components, decontaminate, html_extract, langid, line_dedup, minhash, packing, secret_scan, suffix_dedup, token_files, tokens, vector_links)
from panelspan.session import shared_folder

ODD = [(1, "a b c d e f g"), (2, None), (3, ""), (4, "   \n \t "), (1, "a b c d e f g"), (None, "x y z"), (7, "é" * 3000 + " 日本 it's")]
SCHEMA = "doc_id long, text string, row long, spans string, bucket int"


def documents(spark, rows, partitions=3):
    """The columns that operators name themselves are there as well."""
    return spark.createDataFrame([(i, t, n, "x", 1) for n, (i, t) in enumerate(rows)], SCHEMA).repartition(partitions)


@pytest.fixture(scope="module")
def random_rows():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(8)]
    rows = list(ODD)
    for i in range(10, 90):
        line = [rng.choice(base).split() if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randint(0, 30))] for _ in range(rng.randint(1, 4))]
        for part in line:
            for _ in range(rng.choice([0, 0, 1, 3, 9])):
                if part:
                    part[rng.randrange(len(part))] = rng.choice(words)
        rows.append((i, "\n".join(" ".join(p) for p in line)))
    return rows


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("operator", [
    lambda d: secret_scan.digest(secret_scan.find_secrets(d)), line_dedup.summary, line_dedup.deduplicated, suffix_dedup.remove_repeats,
    lambda d: decontaminate.find(d, d.withColumnRenamed("doc_id", "item_id")), packing.pack, lambda d: langid.identify(d, {}),
    token_files.round_trip, minhash.groups, minhash.deduplicated])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0


def test_secrets(spark):
    rows = ODD + [(10, "password = 'hunter22xx' é Token:abc API-KEY=12345678 api_key: ABCDEFGHIJ"), (11, "é" + "f" * 31), (12, "é" + "0af" * 20 + " AKIA" + "Z" * 12),
                  (13, "AKIAAKIAABCDEFGHIJK secret==abcdefgh ghp_" + "a1B2" * 9), (14, "-----BEGIN RSA PRIVATE KEY-----")]
    got = {r.doc_id: r for r in secret_scan.digest(secret_scan.find_secrets(documents(spark, rows))).collect()}
    assert got[10].n_assign == 2 and got[11].n_hex == 0 and got[12].n_hex == 1 and got[12].n_access == 1
    assert got[10].spans == "assign:0:22,assign:59:78"[: len(got[10].spans)] or got[10].spans.startswith("assign:0:")
    assert got[13].n_access == 1 and "github:" in got[13].spans and got[14].spans == "pem:0:31"
    for i, text in rows:
        if i is not None:
            want = secret_scan.spans_of(text or "")
            assert got[i].spans == ",".join(f"{k}:{s}:{e}" for s, e, k in want)
            base = ",".join(f"{k}:{s}:{e}" for s, e, k in want if k in ("assign", "access", "hex"))
            assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def test_line_dedup(spark, random_rows):
    got = line_dedup.summary(documents(spark, random_rows)).collect()
    seen, want = [], []
    places = sorted({(-2**63 if i is None else i, n, line) for i, t in random_rows if t for n, line in enumerate(t.split("\n"))})
    gone = set()
    for i, n, line in places:
        words = frozenset(line.lower().split())
        if len(words) >= 5:
            if any(9 * len(words & w) >= 4 * (len(words) + len(w)) for (j, m, w) in seen if (j, m) < (i, n)):
                gone.add((i, n, line))
            seen.append((i, n, words))
    for i, t in random_rows:
        lines = t.split("\n") if t else []
        kept = [line for n, line in enumerate(lines) if (-2**63 if i is None else i, n, line) not in gone]
        want.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    same([tuple(r) for r in got], want)
    assert len(gone) > 10
    out = line_dedup.deduplicated(documents(spark, random_rows))
    assert out.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ") and out.count() == len(random_rows)


def test_lines_of_repeated_doc_ids(spark):
    """Lines at the same place are not earlier than each other; extra columns may have any name."""
    similar = [" ".join(["a b c d e f g h i j".split()[k] for k in range(10) if k != gone]) for gone in range(3)]
    rows = [(1, similar[0]), (1, similar[1]), (1, similar[2]), (2, similar[0] + "\nother line here"), (0, "x y")]
    docs = spark.createDataFrame([(i, t, "r", 2, "g") for i, t in rows], "doc_id long, text string, _row string, _gone int, numbers string")
    assert sorted(r.n_removed for r in line_dedup.summary(docs).collect()) == [0, 0, 0, 0, 1]
    out = line_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted(r.text for r in out.collect()) == sorted([*similar, "other line here", "x y"])


def test_nothing_staged_is_left(spark, random_rows):
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    line_dedup.deduplicated(documents(spark, random_rows)).count()
    minhash.groups(documents(spark, random_rows)).count()
    left = set(os.listdir(folder)) - before
    assert sorted(n.rsplit("-", 1)[0] for n in left if not n.startswith(".")) == ["panelspan-groups", "panelspan-line-removals"]


def test_line_dedup_shuffles_entries_once(spark, monkeypatch):
    plans, staged = [], line_dedup.common.staged

    def watched(frame, name, keep=False):
        if name == "line-pairs":
            before = spark.conf.get("spark.sql.adaptive.enabled")
            spark.conf.set("spark.sql.adaptive.enabled", "false")      # else empty results replace the plan
            plans.append(frame.select("*")._jdf.queryExecution().executedPlan().toString())
            spark.conf.set("spark.sql.adaptive.enabled", before)
        return staged(frame, name, keep)

    monkeypatch.setattr(line_dedup.common, "staged", watched)
    rows = [(i, f"one two three four five six seven eight nine ten w{i}\nalone{i} a{i} b{i} c{i} d{i}") for i in range(6)]
    got = {r.doc_id: r.n_removed for r in line_dedup.summary(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1}
    seconds = [p for p in plans if "Join" in p]
    assert len(seconds) == line_dedup.PARTS and all("ReusedExchange" in p for p in seconds)


def test_line_dedup_of_long_lines(spark, monkeypatch):
    """Lines on both sides of LONG, similarities on both sides of 4/5; the second round's shorter lines bring only words that reach them."""
    plans, staged = [], line_dedup.common.staged

    def watched(frame, name, keep=False):
        if name == "line-pairs":
            plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return staged(frame, name, keep)

    monkeypatch.setattr(line_dedup.common, "staged", watched)
    rng, rows = random.Random(5), []
    words = [f"{'äW'[k % 2]}{k}" for k in range(400)]
    for i in range(150):
        line = rng.sample(words, rng.choice([5, 9, 30, 62, 66, 90, 160])) if i < 25 else list(rng.choice(rows)[1].split())
        for _ in range(rng.randint(0, len(line) // 7)):
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = rng.choice(words)
            elif rng.random() < 0.5:
                del line[rng.randrange(len(line))]
            else:
                line.insert(rng.randrange(len(line)), rng.choice(words).upper())
        rows.append((i, " ".join(line)))
    seen, want, margins = [], {}, set()
    for i, text in rows:
        mine = frozenset(text.lower().split())
        scores = [9 * len(mine & w) - 4 * (len(mine) + len(w)) for w in seen]
        margins.update(scores)
        want[i] = int(any(x >= 0 for x in scores))
        seen.append(mine)
    got = line_dedup.summary(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == want
    assert 20 < sum(want.values()) < 130 and {-2, -1, 0, 1, 2} <= margins
    joins = [p for p in plans if "SortMergeJoin" in p]
    assert joins and all("explode(if ((reach" in p for p in joins)


def test_line_dedup_of_short_lines(spark):
    rng = random.Random(8)
    line = lambda: rng.choice(["", " ", "\t"]) + " ".join(rng.choice(["All", "all", "rights", "reserved.", "Menu", "top", "é"]) for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 5, 6, 9])))
    rows = [(1, "All rights reserved.\n\nx"), (2, "  all RIGHTS reserved.\n\nx y"), (3, "reserved. all\trights\n \nX"), (4, "a b c d"), (5, "e d c b a\nd c b a\nb c d"), (6, None), (7, "")]
    rows += [(i, "\n".join(line() for _ in range(rng.randint(1, 4)))) for i in range(10, 70)]
    seen, want = [], []
    for i, t in rows:
        kept, lines = [], t.split("\n") if t else []
        for text in lines:
            words = frozenset(text.lower().split())
            if not any(words and 9 * len(words & w) >= 4 * (len(words) + len(w)) for w in seen):
                kept.append(text)
            seen.append(words)
        want.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    same([tuple(r) for r in line_dedup.summary(documents(spark, rows)).collect()], want)
    assert [w[2] for w in want[:5]] == [0, 1, 2, 0, 2]
    left = {r.doc_id: r.text for r in line_dedup.deduplicated(documents(spark, rows)).collect()}
    assert left[1] == rows[0][1] and left[2] == "\nx y" and left[3] == " " and left[5] == "b c d" and left[6] is None


def test_repeated_passages(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abé \n") for _ in range(n))
    base = [text(400) for _ in range(4)]
    rows = [*ODD, (3, base[0][:150]), (8, "a" * 500), (9, "ab" * 200 + "a" * 130), (9, base[0])]
    for i in range(10, 45):
        rows.append((i, "".join(rng.choice(base)[(s := rng.randrange(300)): s + rng.randrange(40, 260)] if rng.random() < 0.7 else text(rng.randrange(150)) for _ in range(4))))
    first, want = {}, []
    raw = [(-2**63 if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for s in range(len(b) - 99):
            first[b[s: s + 100]] = min(first.get(b[s: s + 100], (2**63, 0)), (i, s))
    for (i, _), (key, b) in zip(rows, raw):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            if first[b[s: s + 100]] < (key, s):
                gone[s: s + 100] = True
        want.append((i, len(b), int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.remove_repeats(documents(spark, rows)).collect()]
    same(got, want)
    assert sum(w[2] for w in want) > 1000


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(0)
    for _ in range(20):
        line, lengths = rng.integers(0, 4, rng.integers(1, 60)), rng.integers(1, 5, 20)
        patterns = rng.integers(0, 5, (20, 4))
        index = decontaminate.FmIndex(line)
        low, high = index.search(patterns, lengths)
        for i, n in enumerate(lengths):
            word = patterns[i, 4 - n:]
            assert sorted(index.locate(np.arange(low[i], high[i]))) == [j for j in range(len(line) - n + 1) if (line[j: j + n] == word).all()]


@pytest.mark.parametrize("block", [200_000, 7])
def test_decontamination(spark, random_rows, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "window_blocks", lambda b, s=10, _=0, f=decontaminate.window_blocks: f(b, s, block))
    items = [(1, random_rows[20][1]), (2, None), (3, "!!"), (4, "b"), (5, random_rows[20][1]), (6, " ".join(random_rows[30][1].split()[:14]).upper())]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = cut(t)
        for k in range(max(len(w) - 10, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[k: k + 10]), set()).add(i)
    want = []
    for i, t in random_rows:
        w, hit, found = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k: k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k: k + n])]
        want.append((i, len(w), len(hit), sorted(found)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, random_rows)
    same([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontaminate.find(docs, benchmark).collect()], want)
    clean = decontaminate.removed(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == len(random_rows)
    left = {(r.doc_id, r.row): len(cut(r.text)) for r in clean.collect()}
    for n, (i, total, hit, _) in enumerate(want):
        assert left[i, n] <= total - hit + 1


def test_main_text():
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a>menu</a></nav><div id="cookie-notice">cookies</div>
      <div class="post-12"><h1>One &amp; two</h1><p>Para  one<br>more <a href=x>link</a><p>Para &lt;two&gt;&nbsp;x<ul><li>a<li>b</ul>
      <script>var a="<p>no</p>"</script><form><label>Mail</label></form><div class="comments"><p>nice</p></div></div><aside>side</aside><footer>foot</footer></body></html>"""
    assert html_extract.extract(page) == "One & two\n\nPara one more link\n\nPara <two> x\n\na\n\nb"
    assert html_extract.extract(None) == html_extract.extract("") == "" and html_extract.extract("just <b>text") == "just text"


def test_hosts_agree_on_a_path(spark):
    body = "<html><body><div class=main{0}><p>{1}</p></div><div class=other><p>{2}</p></div></body></html>"
    rows = [(i, "http://h.example/x", body.format(i, "good " * 50, "bad " * 5)) for i in range(5)] + [(9, "http://h.example/y", body.format(9, "short", "bad " * 60)), (10, None, None)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "short" and got[0] == ("good " * 50).strip() and got[10] == ""


def test_text_beside_a_large_container_stays():
    lead, rest = "lead " * 35, "rest " * 65
    whole = f"Title\n\n{lead.strip()}\n\n{rest.strip()}"
    pages = ["<body><nav>menu</nav><div id=content><h1>Title</h1><p>{0}</p><div class=rest><p>{1}</p></div></div><footer>x</footer></body>",
             "<body><div><h1>Title</h1><p>{0}</p><blockquote><p>{1}</p></blockquote></div></body>", "<body><h1>Title</h1><p>{0}</p><blockquote>{1}</blockquote></body>",
             "<body><div><div><h1>Title</h1></div><div class=a>{0}</div><div class=b>{1}</div></div></body>", "<main><h1>Title</h1><p>{0}</p><article>{1}</article></main>",
             "<body><div><h1><a href=x>Title</a></h1><section>{0}</section><section><div>{1}</div></section></div></body>"]
    for page in pages:
        assert html_extract.extract(page.format(lead, rest)) == whole, page
    links = "<body><div><ul><li><a href=a>first link</a> | <a href=b>second link</a></ul><div class=main><p>{1}</p></div></div></body>"
    assert html_extract.extract(links.format(lead, rest)) == rest.strip()
    # voted by pages without a lead
    assert html_extract.extract(pages[0].format(lead, rest), [">body>div>div.rest"]) == whole
    assert html_extract.extract(f"<body><div class=x>{lead}</div><div class=p1>{rest}</div><div class=p2>{lead}</div></body>", [">body>div.p#"]) == f"{rest.strip()}\n\n{lead.strip()}"


def test_wrappers_are_no_boilerplate():
    text, more = "text " * 60, "more " * 60
    for wrapper in ("div class='page has-sidebar'", "div class=content-sidebar-wrap", "div id=no-sidebar", "div class=site-header-fixed", "form action=x", "section class=comments-open"):
        end = wrapper.split()[0]
        for inner in ("<article>{}</article>", "<main><p>{}</p></main>", "<div><p>{}</p></div>", "<form><div class=widget-area>{}</div></form>"):
            page = f"<body><div class=sidebar>side</div><{wrapper}>{inner.format(text)}<div class=ad>buy</div><div class=sidebar>side</div></{end}><footer>foot</footer></body>"
            assert html_extract.extract(page) == text.strip(), page
    comments = f"<ol class=commentlist><li class=comment><article>{more}</article><li class=comment><article>{more}</article></ol>"
    for page in ("<body><div class=has-sidebar><article>{0}</article>{1}</div></body>", "<body><div class=has-sidebar><p>{0}</p>{1}</div></body>", "<article>{0}{1}</article>", "<article>{0}</article><div class=comments>more{1}</div>"):
        assert html_extract.extract(page.format(text, comments)) == text.strip(), page
    assert html_extract.extract(f"<body><div class=post>{text}</div><div class=related><article>teaser</article></div></body>") == text.strip()
    assert html_extract.extract("<article><p>a <math><mi>x</mi></math> b <label>c</label><p><span class=ad>z</span>d<form><label>mail</label></form></article>") == "a x b c\n\nd"


def test_packing(spark, random_rows, library):
    random_rows = random_rows + MARKED
    got = packing.pack(documents(spark, random_rows)).collect()
    ids = {}
    for i, t in random_rows:
        ids.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 0])
    places = {}
    for r in got:
        assert any(zlib.crc32(np.array(x[r.start: r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and len(x) == r.doc_tokens for x in ids[r.doc_id])
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in places.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 1024
    assert sum(r.length for r in got) == sum(len(x) for v in ids.values() for x in v)


def test_cuts_are_optimal():
    rng = np.random.default_rng(1)
    pad = lambda n: 0 if n & (n - 1) == 0 else 16 - n
    for _ in range(40):
        places = np.unique(rng.integers(1, 8, 12).cumsum())
        costs = rng.integers(0, 4, len(places)).astype(float)
        best = {0: 0.0}
        for j, place in enumerate(places.tolist()):
            best[place] = min((f + pad(place - i) for i, f in best.items() if place - i <= 16)) + costs[j] + packing.PER_SEQUENCE
        chosen = packing.cuts(places, costs, 16).tolist()
        cost = sum(pad(b - a) + costs[places.tolist().index(b)] + packing.PER_SEQUENCE for a, b in zip([0, *chosen], chosen))
        assert cost == best[int(places[-1])]


@pytest.fixture(scope="module")
def library():
    """The tokenizers library by itself, as a user would load it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary())


MARKED = [(91, "end <|endoftext|> of"), (92, "<|endoftext|>"), (93, "a<|endoftext|><|endoftext|>b it's"), (94, "<|endoftext"), (95, "|> <|endof text|>")]


def test_token_files(spark, random_rows, library):
    random_rows = random_rows + MARKED
    values = np.array([0, 1, 255, 256, 65535, 65536, 2**24, 2**32 - 1, 7], np.uint32)
    assert (token_files.decode(*token_files.encode(values), 9) == values).all()
    start, want = 0, []
    for i, t in sorted(random_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    same([tuple(r) for r in token_files.round_trip(documents(spark, random_rows)).collect()], want)


def test_files_follow_each_other(spark, tmp_path, monkeypatch):
    """In ascending doc_id order within and across the files, by their names."""
    monkeypatch.setattr(token_files, "BLOCK", 300)
    rows = [(i, f"text {i} " * (i % 50)) for i in random.Random(1).sample(range(10**6), 900)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        token_files.write(documents(spark, rows, 6), str(tmp_path / "t"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    files = sorted((tmp_path / "t" / "blocks").glob("part-*.parquet"))
    assert len(files) > 3
    blocks = [b for f in files for b in pq.read_table(f).to_pylist()]
    assert [i for b in blocks for i in b["doc_ids"]] == sorted(i for i, _ in rows)
    assert [b["first"] for b in blocks] == [0, *np.cumsum([sum(b["counts"]) for b in blocks])[:-1].tolist()]


def test_words_are_cut_like_the_librarys(library):
    encoder = tokens.encoder(tokens.default_vocabulary())
    texts = ["", "a  b", "  x", "x  ", "\n\n a\t\tb \n", "it's 'sup ''s", "a1 b2²½ ª", "  ", "日本 x", "a\r\n b", "...!? . x_y --", "ñ€x", "<|endoftext|> a", *(t for _, t in MARKED), "x y", "a \u0085 b", "\x1c a\x00"]
    offsets, data = np.cumsum([0, *(len(t.encode()) for t in texts)]), np.frombuffer("".join(texts).encode(), np.uint8)
    ids, counts, _ = encoder.encode(data, offsets)
    ends = np.cumsum(counts)
    for t, a, b in zip(texts, ends - counts, ends):
        assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids


def test_languages(spark):
    rng = random.Random(0)
    word = {"en": ["the", "and", "with", "that", "house"], "de": ["der", "und", "nicht", "über", "haus"]}
    rows = [(i, " ".join(rng.choice(word[lang]) for _ in range(40)), lang) for i in range(200) for lang in [rng.choice(["en", "de"])]]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 !", "de"), (902, "und", None), (None, "the house", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(docs).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, lang in rows)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "de" and got[None].lang_pred == "en"
    assert langid.keep_known(docs).count() == len(rows) + 2


def test_texts_in_no_known_language_are_rejected(spark):
    rows = [(i, text, lang) for i in range(20) for text, lang in [("the house and that", "en"), ("das haus und nicht", "de")]]
    foreign = [(100, "καλημέρα κόσμε", None), (101, "доброе утро", ""), (105, "日本語", None)]
    docs = spark.createDataFrame([*rows, *foreign, (106, "доброе the house", None)], "doc_id long, text string, lang string")
    docs = docs.withColumn("lang", F.expr("nullif(lang, '')"))
    assert sorted(r.doc_id for r in langid.keep_known(docs).collect()) == sorted([*(i for i, _, _ in rows), 106])


def test_vector_links(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((300, 24))
    near = base[rng.integers(0, 20, 400)] + rng.standard_normal((400, 24)) * 0.3
    vectors = np.concatenate([base, near]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(2000, vectors[0].tolist()), (2001, None), (2002, []), (2003, [0.0] * 24), (2004, [float("nan")] * 24), (2005, [1.0, None]), (2006, [1.0, 2.0])]
    got = {r.vec_id: r for r in vector_links.links(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    all_ = np.concatenate([vectors, vectors[:1]]).astype(float)
    unit = all_ / np.linalg.norm(all_, axis=1)[:, None]
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    ids = [*range(700), 2000]
    assert sum(got[i].n_links for i in ids) >= 0.98 * links.sum() and all(got[i].n_links <= n for i, n in zip(ids, links.sum(axis=1)))
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(2001, 2007)) and got[2000].component_id == got[0].component_id


def test_near_duplicates(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows = list(ODD)
    for i in range(10, 40):
        base = [rng.choice(words) for _ in range(rng.randint(6, 300))]
        rows.append((i, " ".join(base)))
        for k in range(4):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((100 * i + k, " ".join(copy)))
    features = {}
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        count = {}
        for k in range(max(len(w) - 4, 1) if w else 0):
            count[tuple(w[k: k + 5])] = count.get(tuple(w[k: k + 5]), 0) + 1
        features[i] = count

    def alike(a, b):
        both = set(a) | set(b)
        return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in both) for i in set(a) & set(b))

    ids = [i for i in features if features[i]]
    label = {i: i for i in ids}
    edges = [(x, y) for n, x in enumerate(ids) for y in ids[:n] if set(features[x]) & set(features[y]) and alike(features[x], features[y]) >= 0.8]
    for _ in ids:
        for x, y in edges:
            label[x] = label[y] = min(label[x], label[y], key=lambda v: (v is None, v or 0))
    got = {r.doc_id: r.class_id for r in minhash.groups(documents(spark, rows)).collect()}
    assert all(got[i] == label[i] for i in ids) and len(edges) > 20
    kept = [r.doc_id for r in minhash.deduplicated(documents(spark, rows)).drop("row").collect()]
    assert {i for i in kept if i in label} == {i for i in ids if label[i] == i} and {2, 3, 4} <= set(kept)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (5, 5), (None, 3)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(41)) and {got[i] for i in (100, 101, 102)} == {100}


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    out = corpus_pipeline.run(spark, folder)
    assert 0.8 * before < out.select("doc_id").distinct().count() <= before
