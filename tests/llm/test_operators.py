"""Each operator against a brute-force version, SQL, a round trip or held-out labels; then the odd inputs."""

import itertools
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import _util, chat_format, decontam, html_extract, line_dedup, minhash_dedup, mixing, quality_rules, sharding, suffix_dedup, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named like the operators' own, which they carry along or ignore.
CLASH = ("node", "key", "__node", "run", "anchor", "block", "quota", "root", "seeds", "words", "line", "score", "draw")


def make(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], DOCS)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    passage = prose(rng, 60)
    rows = [(i, prose(rng, rng.randrange(20, 150)), f"src{i % 4}") for i in range(40)]
    for i in range(40, 60):
        w = rows[i - 40][1].split()
        for _ in range(len(w) // 25):
            w[rng.randrange(len(w))] = "edit"
        rows.append((i, " ".join(w), "src1"))
    rows += [(60, f"{prose(rng, 30)} {passage} {prose(rng, 9)}", "src0"), (61, f"{passage} {prose(rng, 30)}", "src0"), (62, rows[0][1], None)]
    return rows


def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, and clashing columns."""
    long = " ".join(f"t{i % 997}" for i in range(120_000))
    rows = [(None, None, None), (None, "a b c", "src0"), (1, None, "src0"), (2, "", None), (3, "  \n\n ", "src1"), (4, "same text here", "src1"), (4, "same text here", "src1"), (5, "same text here", "src2"), (6, long, "src2"), (7, "é 漢字   x\x00y", "src3")]
    return make(spark, rows).withColumns({c: F.lit(c) for c in CLASH})


# --- results ------------------------------------------------------------------------------


def test_html_template_and_content(spark):
    page = lambda i: f"<html><head><title>t{i}</title></head><body><nav>Home | About</nav><div class=a><h1>Title {i}</h1><p>Body number {i} of the page<p>second {i * 7}</div><footer>All rights</footer></body></html>"
    got = html_extract.extract([page(i) for i in range(8)])
    assert [g[0] for g in got] == [f"Title {i}\nBody number {i} of the page\nsecond {i * 7}" for i in range(8)]
    df = spark.createDataFrame([(i, "http://Host.example/x", page(i)) for i in range(8)], "page_id long, url string, html string")
    assert {r.content for r in html_extract.contents(df).collect()} == {g[0] for g in got}


def test_html_repeats_count_once_and_varying_slots_are_content(spark):
    page = lambda i, who="x": f"<body><nav>Home</nav><div><p>by {who}<p>Article number {i}</div><footer>All rights</footer></body>"
    want = ["by a\nArticle number 0", "by a\nArticle number 0", "by b\nArticle number 1"]
    assert [g[0] for g in html_extract.extract([page(0, "a"), page(0, "a"), page(1, "b")])] == want
    assert html_extract.extract([page(0)] * 2) == html_extract.extract([page(0)]) * 2
    pages = [page(i, "abc"[i % 3]) for i in range(30)]
    assert [g[0] for g in html_extract.extract(pages)] == [f"by {'abc'[i % 3]}\nArticle number {i}" for i in range(30)]
    # two templates on one host
    two = [p.replace("Home", "Start<b>Shop</b>").replace("All rights", "Imprint") if i % 2 else p for i, p in enumerate(pages)]
    assert [g[0] for g in html_extract.extract(two)] == [g[0] for g in html_extract.extract(pages)]
    df = spark.createDataFrame([(i, "http://h.example/", p) for i, p in enumerate(two)] + [(None, "http://h.example/", two[0])], "page_id long, url string, html string")
    for limit in (html_extract.LIMIT, 0):  # wrappers broadcast, or sorted before the parts of a host
        once = {(r.page_id, r.content) for r in html_extract.contents(df, limit=limit, salted=4).collect()}
        again = [(r.page_id, r.content) for r in html_extract.contents(df.union(df), limit=limit, salted=4).collect()]
        assert set(again) == once and len(again) == 2 * len(once) == 62 and (None, "by a\nArticle number 0") in once


def test_html_near_copies_keep_their_article():
    page = lambda nav, body: f"<body><nav><a>{nav} one</a><a>{nav} two</a></nav><div><p>{body}<p>more of {body}</div><footer>All rights</footer></body>"
    copies = [page(f"n{i}", "the same article") for i in range(4)]
    for pages in (copies[:2], copies, copies + [page("n9", f"article {i}") for i in range(12)]):
        assert html_extract.extract(pages)[0][0].endswith("the same article\nmore of the same article")


def test_html_rows_against_plain_sets_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    odd_ones = [(10_000 + i, "http://odd.example/", h) for i, h in enumerate([None, "", "<p>a<p>b", "<ul><li>a<li>b</ul>", "<p>a<p>b", "x</div>"])]
    pages = pages.select("page_id", "url", "html").union(spark.createDataFrame(odd_ones, "page_id long, url string, html string")).union(pages.select("page_id", "url", "html").where("page_id % 7 = 0"))
    row = lambda r: (r.page_id, r.content, r.template_nodes, r.content_nodes)
    got = [html_extract.contents(pages, limit=limit, salted=8).collect() for limit in (html_extract.LIMIT, 0)]
    assert sorted(map(row, got[0])) == sorted(map(row, got[1]))
    host = {r.page_id: r.host for r in got[0]}
    by: dict = {}
    for p in pages.collect():
        by.setdefault(host[p.page_id], []).append(p)
    want = [(p.page_id, *w) for ps in by.values() for p, w in zip(ps, html_extract.extract([p.html for p in ps]))]
    assert sorted(map(row, got[0])) == sorted(want) and any(r.template_nodes > 1 for r in got[0])


def test_html_of_any_depth_and_width_is_aligned():
    assert [g[0] for g in html_extract.extract(["<div>" * 3000 + "x", "<div>" * 2900 + "y"])] == ["x", "y"]
    rng = random.Random(2)
    wide = lambda k: "".join(rng.choice(["<p>{}</p>", "<ul><li>{}</ul>", "<h2>{}</h2>"]).format(f"{k} {i}") for i in range(1500))
    got = html_extract.extract([f"<nav>Home</nav>{wide(k)}<footer>End</footer>" for k in range(3)])
    assert [(a, b) for _, a, b in got] == [(2, 1500)] * 3
    # by halves or as one table, a mapping of the same size
    w = np.array([[3, 0], [1, 2]])
    a, b = (np.array([rng.randrange(2) for _ in range(n)]) for n in (400, 300))
    pairs = html_extract._pairs(w, a, b)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    assert sum(w[a[i], b[j]] for i, j in pairs) == html_extract._row(w, a, b)[-1]


def test_simple_tree_matching_against_all_mappings():
    rng = random.Random(1)

    def tree(depth):
        return f"<{(t := rng.choice(['div', 'b']))}>" + "".join(tree(depth - 1) for _ in range(rng.randrange(3)) if depth) + f"</{t}>"

    def brute(s, t, a=0, b=0):
        if s.tag[a] != t.tag[b]:
            return 0
        p, q, best = s.kids[a], t.kids[b], 0
        for k in range(min(len(p), len(q)) + 1):
            for x in itertools.combinations(p, k):
                for y in itertools.combinations(q, k):
                    best = max(best, sum(v if (v := brute(s, t, *two)) else -99 for two in zip(x, y)))
        return 1 + best

    for _ in range(40):
        a, b = html_extract.parse(tree(3)), html_extract.parse(tree(3))
        aligner = html_extract.Aligner(a)
        assert aligner.match(aligner.cls[0], aligner.classes(b)[0]) == brute(a, b)


def test_minhash_groups_against_all_pairs(spark, corpus):
    rows = [(d, t) for d, t, _ in corpus]
    brute = minhash_dedup.brute_force(rows)
    want = {}
    for i, r in brute.items():
        want.setdefault(r, []).append(rows[i][0])
    want = sorted(sorted(g) for g in want.values() if len(g) > 1)
    got = minhash_dedup.near_duplicates(make(spark, corpus)).toPandas()
    assert sorted(sorted(g) for g in got.groupby("group_id")["doc_id"].apply(list)) == want and len(want) > 5
    assert set(got[got["keep"]]["doc_id"]) == {g[0] for g in want}
    kept = {r.doc_id for r in minhash_dedup.drop_near_duplicates(make(spark, corpus)).collect()}
    assert kept == {d for d, _ in rows} - {x for g in want for x in g[1:]}


def test_hot_groups_give_the_same_rows(spark, monkeypatch):
    """More copies of a text than are joined in one task, and a bucket of several components in several blocks."""
    monkeypatch.setattr(_util, "FLOOR", 20)
    rng = random.Random(8)
    hot = prose(rng, 60)
    near = " ".join(hot.split()[:-2])
    rows = [(i, hot, "s") for i in range(5, 1300)] + [(None, hot, "s"), (5, hot, "s"), (4, near, "s"), (2000, prose(rng, 50), "s"), (2001, None, "s")]
    got = minhash_dedup.near_duplicates(make(spark, rows)).toPandas()
    assert len(got) == len(rows) - 2 and set(got["group_id"]) == {4} and set(got["group_size"]) == {len(rows) - 2} and got["keep"].sum() == 1
    kept = [r.doc_id for r in minhash_dedup.drop_near_duplicates(make(spark, rows)).collect()]
    assert sorted(kept) == [4, 2000, 2001]
    kept = [r.doc_id for r in minhash_dedup.drop_near_duplicates(make(spark, rows[:-3])).collect()]
    assert kept == [5]
    # 40 members in one bucket, alike in pairs
    sig = lambda k: np.array([rng.randrange(1 << 30) if i % 5 == k % 2 else k // 2 for i in range(160)], "<u4").tobytes()
    sigs = [(i, bytearray(sig(i))) for i in range(40)]
    split = spark.createDataFrame([(7, i, i) for i in range(40)], "key long, node long, root long")
    edges = {(min(r.a, r.b), max(r.a, r.b)) for r in minhash_dedup._crossed(split, spark.createDataFrame(sigs, "node long, sig binary"), 0.5, block=7).collect()}
    assert edges == {(i, i + 1) for i in range(0, 40, 2)}


def test_components_are_those_of_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    root = list(range(400))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in minhash_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {v for a, b in edges if a != b for v in (a, b)}}


def test_suffix_array_and_prefixes_against_sorting():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 60, 400):
        t = np.append(rng.integers(1, 4, n), 0)
        sa = suffix_dedup.suffix_array(t)
        want = sorted(range(n + 1), key=lambda i: t[i:].tolist())
        assert sa.tolist() == want
        lcp = suffix_dedup.common_prefixes(t, sa).tolist()
        for k in range(1, n + 1):
            a, b = t[want[k - 1] :].tolist(), t[want[k] :].tolist()
            assert lcp[k] == len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(a, b))))


@pytest.mark.parametrize("least", [12, 50])
def test_repeated_passages_against_all_runs(spark, corpus, least):
    loop = " ".join(f"x{i % 30}" for i in range(200))
    rows = [*corpus, (70, loop, "s"), (71, f"a {loop[:300]}", "s")]
    want = suffix_dedup.brute_force([(d, t) for d, t, _ in rows], least)
    got = suffix_dedup.repeated(make(spark, rows), least).collect()
    assert {(r.doc_id, k, r.is_first) for r in got for k in range(r.start_word, r.end_word)} == want and want


def test_later_passages_are_deleted(spark, corpus):
    rng = random.Random(12)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"Begin {passage}, and on", "s"), (2, f"É start. {passage.upper()}! Rest stays", "s"), (3, prose(rng, 80), "s"), (None, passage, "s"), (4, None, "s"), (5, "", "s")]
    got = {r.doc_id: r.text for r in suffix_dedup.drop_passages(make(spark, rows).withColumns({c: F.lit(c) for c in CLASH})).collect()}
    assert got == {1: rows[0][1], 2: "É start. ! Rest stays", 3: rows[2][1], None: "", 4: None, 5: ""}
    left = suffix_dedup.repeated(suffix_dedup.drop_passages(make(spark, corpus))).count()
    assert left == 0 and suffix_dedup.repeated(make(spark, corpus)).count() > 0


def test_line_runs_against_all_runs(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice(["", " ", *(f"line {k}" for k in range(12))]) for _ in range(rng.randrange(1, 14))), "s") for i in range(40)]
    rows += [(90, "a\na\na\na\na", "s"), (91, "a\na\nb", "s")]
    for least in (2, 3):
        want = line_dedup.brute_force([(d, t) for d, t, _ in rows], least)
        got = {r.doc_id: r.text for r in line_dedup.drop_lines(make(spark, rows), least).collect()}
        assert [got[d] for d, _, _ in rows] == want
        assert want != [t for _, t, _ in rows]


def test_a_line_that_repeats_alone_is_a_run(spark):
    rows = [(0, "only", "s"), (1, "a0\nboiler\nb0", "s"), (2, "only", "s"), (3, "a1\n boiler\nb1", "s"), (4, "a2\nboiler\nboiler", "s")]
    got = {r.doc_id: r for r in line_dedup.report(make(spark, rows)).collect()}
    assert [got[d].text for d in range(5)] == ["only", "a0\nboiler\nb0", "", "a1\nb1", "a2"]
    assert [got[d].text for d in range(5)] == line_dedup.brute_force([(d, t) for d, t, _ in rows])
    assert [got[d].lines_deleted for d in range(5)] == [0, 0, 1, 1, 2]


def test_contamination_against_aligning_everything(spark, corpus):
    rng = random.Random(9)
    items = [(i, prose(rng, 30, 5000)) for i in range(6)]
    edited = items[1][1].split()
    edited[7:9] = ["other"]
    edited[20] = "odd"
    docs = [*corpus, (100, f"{prose(rng, 40)} {items[0][1]} {prose(rng, 5)}", "s"), (101, f"x {' '.join(edited)}", "s"), (102, items[2][1].upper(), "s"), (103, " ".join(items[3][1].split()[:9]), "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(make(spark, docs), bench).collect()}
    assert got == decontam.brute_force([(d, t) for d, t, _ in docs], items) == {(100, 0), (101, 1), (102, 2)}
    assert {r.doc_id for r in decontam.drop_contaminated(make(spark, docs), bench).collect()} == {d for d, _, _ in docs} - {100, 101, 102}


def test_half_an_item_in_more_than_a_thousand_documents_is_found(spark):
    rng = random.Random(11)
    item = " ".join(f"q{i}" for i in range(40)).split()
    # both halves are in more than 1000 documents, the second in fewer: its seeds are the rarer half
    docs = [(i, f"{prose(rng, 5)} {' '.join(item[:24])} {prose(rng, 5)}", "s") for i in range(1300)]
    docs += [(i, f"{prose(rng, 5)} {' '.join(item[16:])} {prose(rng, 5)}", "s") for i in range(1300, 2400)]
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    got = {r.doc_id for r in decontam.contaminated(make(spark, docs), bench).collect()}
    assert got == {d for d, _, _ in docs}


def test_chat_round_trip_and_mask(spark):
    turns = [(1, 1, "assistant", "Hi <|end|> there"), (1, 0, "user", "Hello <|start|>"), (1, 2, "user", None), (2, 0, "narrator", "x"), (2, 1, None, "é <\\|x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.chats(df).collect()}
    t, R = chat_format.tokenizer(chat_format.TOKENIZER), chat_format.RESERVED
    ids, mask = got[1].input_ids, got[1].loss_mask
    assert len(ids) == len(mask) == got[1].n_tokens and ids.count(R["end"]) == 3 and ids[0] == R["begin"]
    trained = [i for i, m in zip(ids, mask) if m]
    assert trained[-1] == R["end"] and chat_format.unescape(t.decode(trained[:-1])) == "Hi <|end|> there"
    assert not any(got[2].loss_mask) and chat_format.unescape(t.decode([i for i in ids if i < R["begin"]])) == "Hello <|start|>Hi <|end|> there"
    for s in ("<|", "<\\|", "<\\\\|a<|b"):
        assert chat_format.unescape(chat_format.escape(s)) == s and "<|" not in chat_format.escape(s)


def test_chats_against_a_token_at_a_time(spark):
    known = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = [(-1, None, None, None), (-1, 2, "assistant", "<|end|> a"), (-1, 2, "assistant", "<|end|> a"), (-1, 2, "assistant", "b"), (-1, 1, "odd <|x|>", ""), (-2, 0, "assistant", "z " * 30_000)]
    df = known.union(spark.createDataFrame(extra, known.schema))
    by: dict = {}
    for r in df.collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    got = {r.conv_id: r for r in chat_format.chats(df).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        assert (got[c].input_ids, got[c].loss_mask) == chat_format.brute_force(turns)
        assert (got[c].n_turns, got[c].n_tokens, got[c].n_trained) == (len(turns), len(got[c].input_ids), sum(got[c].loss_mask))
    # long conversations come in parts; turns without a conversation each on their own
    parts = chat_format.chats(spark.createDataFrame([(5, i, "user", f"t{i}") for i in range(10)] + [(None, 0, "user", "a")] * 3, known.schema), span=4).collect()
    assert sorted((r.part, r.n_turns) for r in parts if r.conv_id == 5) == [(0, 4), (1, 4), (2, 2)] and sum(r.conv_id is None for r in parts) == 3


def plain_votes(t):
    """The rules of one text in plain Python."""
    words = [m.group() for m in re.finditer(r"(?:[0-9A-Za-z_]|[^\x00-\xbf\u2000-\u207f\u3000-\u303f])+", (t or "").lower())]
    n, t = len(words), t or ""
    if not n:
        return [-1] * 12
    raw = t.encode()
    odd = set(b"#$%&*@^~=+<>{}[]|\\/_")
    letters = sum(65 <= c <= 90 or 97 <= c <= 122 for c in raw)
    pairs = list(zip(raw, raw[1:] + b"\0"))
    high = lambda x, good, bad: -1 if x > bad else 1 if x <= good else 0
    size = sum(len(w.encode()) for w in words) / n
    variety = len(set(words)) / math.sqrt(n)
    sentences = sum(c in b".?!" for c in raw) / n
    grams = [tuple(words[i : i + 4]) for i in range(n - 3)]
    brief = n < 20
    return [
        -1 if n < 3 else 1 if n >= 40 else 0,
        0 if letters < 20 else high(sum(65 <= c <= 90 for c in raw) / letters, 0.15, 0.4),
        high(sum(c in odd for c in raw) / n, 0.02, 0.15),
        0 if brief else -1 if size > 14 or size < 2.5 else 1 if 3 < size < 10 else 0,
        0 if brief else high(sum(a == b for a, b in zip(words, words[1:])) / n, 0.02, 0.15),
        0 if brief else -1 if variety < 1.5 else 1 if variety > 3 else 0,
        high(sum(c == ord("|") for c in raw) / n, 0.005, 0.15),
        high(sum(a == b == ord("!") for a, b in pairs) / n, 0.01, 0.15),
        0 if brief else -1 if sentences < 0.005 or sentences > 0.6 else 1 if 0.03 < sentences < 0.35 else 0,
        0 if len(grams) < 20 else high(1 - len(set(grams)) / len(grams), 0.1, 0.35),
        high(sum(a in odd and a == b for a, b in pairs) / n, 0.01, 0.1),
        high(sum(a in odd and b not in odd for a, b in pairs) / n, 0.02, 0.2),
    ]


def test_posteriors_against_plain_expectation_maximisation(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    v = {r.doc_id: plain_votes(r.text) for r in rows}
    some = [r.doc_id for r in rows if (r.text or "").split() and plain_votes(r.text) != [-1] * 12 or re.search(r"\w", r.text or "")]
    q = {d: 1 / (1 + math.exp(2.0 * v[d].count(-1) - 2.0)) for d in some}
    for _ in range(200):
        p = [[{}, {}] for _ in range(12)]
        for r in range(12):
            for c in (0, 1):
                w = {x: sum((q[d] if c else 1 - q[d]) for d in some if v[d][r] == x) + 0.5 for x in (-1, 1)}
                p[r][c] = {0: 1.0, **{x: w[x] / (w[-1] + w[1]) for x in w}}
        prior = min(max(sum(q.values()) / len(some), 1e-3), 1 - 1e-3)
        new = {d: 1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + sum(math.log(p[r][1][x] / p[r][0][x]) for r, x in enumerate(v[d]))))) for d in some}
        done = max(abs(new[d] - q[d]) for d in some) < 1e-9
        if done:
            break
        q = new
    got = quality_rules.posteriors(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [r[f"vote_{x}"] for x in quality_rules.RULES] == v[r.doc_id]
        assert abs(r.posterior - (new[r.doc_id] if r.doc_id in new else 0.0)) < 1e-6


def test_quality_on_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in quality_rules.keep_good(docs).collect()}
    lab = labels.dropna().toPandas()
    said = lab["doc_id"].isin(kept)
    assert (said == (lab["quality"] == 1)).mean() > 0.95


def test_expectation_maximisation_finds_the_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.8
    acc = np.array([0.95, 0.85, 0.9, 0.7, 0.92])
    v = np.where((rng.random((20_000, 5)) < acc) == good[:, None], 1, -1)
    v[rng.random(v.shape) < 0.2] = 0
    prior, p = quality_rules.estimate(v, np.ones(len(v)))
    assert abs(prior - 0.8) < 0.03
    assert np.abs(p[:, 1, 2] - acc).max() < 0.03 and np.abs(p[:, 0, 0] - acc).max() < 0.05


def duck(sql, rows):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "source": pa.array([r[2] for r in rows], pa.string())}))
    return sorted(con.execute(sql).fetchall())


def test_mixing_against_sql(spark, corpus):
    params = {"weights": {"src0": 2.0, "src3": 0.0}, "share": 0.6, "block_tokens": 100, "shard_tokens": 1500}
    cols = ["doc_id", "source", "n_tokens", "shard", "block", "quota"]
    got = mixing.allocate(make(spark, corpus), **params).select(cols).collect()
    assert sorted(map(tuple, got)) == duck(mixing.sql(**params), corpus) and got
    assert {r.doc_id for r in mixing.mix_documents(make(spark, corpus), **params).collect()} == {r.doc_id for r in got}
    assert not {r.source for r in got} & {"src3"}


def test_apportionment_is_sainte_lague(spark):
    rows = [(i, "w " * 10, f"s{i % 3}") for i in range(300)]
    got = mixing.allocate(make(spark, rows), weights={"s0": 5.0, "s1": 3.0}, other=1.0, share=0.3, block_tokens=10).toPandas()
    seats, quota = 90, {"s0": 0, "s1": 0, "s2": 0}
    for _ in range(seats):
        s = max(quota, key=lambda x: ({"s0": 5, "s1": 3, "s2": 1}[x] / (2 * quota[x] + 1), -int(x[1])))
        quota[s] += 1
    assert got.groupby("source")["quota"].first().to_dict() == quota


def test_mixture_reports_the_share_reached_beside_the_target(spark):
    rows = [(i, "w " * 10, "src0") for i in range(80)] + [(100 + i, "w " * 10, "src1") for i in range(19)] + [(200, "w " * 50, "src1"), (300, "w", "src2")]
    got = {r.source: r for r in mixing.mixture(make(spark, rows), {"src0": 1.0, "src2": 0.0}, share=0.9, block_tokens=10).collect()}
    assert {s: r.target for s, r in got.items()} == {"src0": 0.5, "src1": 0.5, "src2": 0.0}
    seats = {s: mixing.allocate(make(spark, rows), {"src0": 1.0, "src2": 0.0}, share=0.9, block_tokens=10).where(F.col("source") == s).select("shard", "block").distinct().count() for s in ("src0", "src1")}
    assert abs(got["src0"].seat_share - seats["src0"] / sum(seats.values())) < 1e-9 and got["src0"].seat_share > 0.7
    assert got["src1"].token_share > got["src1"].seat_share and got["src1"].kept == 1 and got["src2"].kept == 0


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(1)
    e, trans = rng.normal(size=9) * 2, rng.normal(size=4)
    of = np.array([0, 5, 5, 9])
    alpha, beta, _, _ = toxicity.marginals(e, of, trans)
    p = toxicity.posterior(alpha, beta)
    for a, z in zip(of[:-1], of[1:]):
        weight = {y: np.exp(sum(e[a + i] * v for i, v in enumerate(y)) + sum(trans[2 * u + v] for u, v in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=z - a)}
        for i in range(z - a):
            assert abs(p[a + i] - sum(w for y, w in weight.items() if y[i]) / sum(weight.values())) < 1e-9


def plain_score(text, m, base=0.0):
    """Score and offsets by one recursion over a text's words, in plain Python; the levels alone come from the operator's tables."""
    arr = pa.array([text], pa.string())
    w = toxicity.words(arr)
    lv = toxicity._levels(w, toxicity.Scorer(m).lexicon)
    spans = [x.span() for x in re.finditer(r"(?:[0-9A-Za-z_]|[^\x00-\xbf\u2000-\u207f\u3000-\u303f])+", text.lower())]
    assert len(spans) == lv.shape[1]
    theta, t = m["theta"], [[m["trans"][0], m["trans"][1]], [m["trans"][2], m["trans"][3]]]
    e = [theta[0] + sum(theta[1 + r * toxicity.LEVELS + int(v) - 1] for r, v in enumerate(col) if v) for col in lv.T]
    emit = [[1.0, math.exp(x)] for x in e]
    alpha, beta = [], []
    for i, p in enumerate(emit):
        a = p if not i else [p[y] * sum(alpha[-1][x] * math.exp(t[x][y]) for x in (0, 1)) for y in (0, 1)]
        alpha.append([v / sum(a) for v in a])
    for i in range(len(emit) - 1, -1, -1):
        b = [1.0, 1.0] if not beta else [sum(math.exp(t[x][y]) * emit[i + 1][y] * beta[-1][y] for y in (0, 1)) for x in (0, 1)]
        beta.append([v / sum(b) for v in b])
    p = [a[1] * b[1] / (a[0] * b[0] + a[1] * b[1]) for a, b in zip(alpha, beta[::-1])]
    return sum(p) - len(p) * base, [(*s, q) for s, q in zip(spans, p) if q >= 0.5]


def test_toxic_rows_against_plain_recursion(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.model(docs, labels)
    some = docs.select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "é 漢字 – x\u3001y " * 50)], "doc_id long, text string"))
    got = {r.doc_id: r for r in toxicity.score(some, m).collect()}
    toxic = 0
    none = {**m, "lexicon": [[[], []]] * toxicity._KINDS}
    base = plain_score("w " * 401, none)[0] / 2 - plain_score("w " * 201, none)[0] / 2
    base /= 100  # what a hundred more words without evidence add
    for r in some.collect():
        score, spans = plain_score(r.text or "", m, base)
        g = got[r.doc_id]
        assert abs(g.score - score) < 1e-6 * max(1, score) and g.toxic == (score >= m["threshold"])
        assert [(x.start, x.end) for x in g.spans or []] == ([x[:2] for x in spans] if g.toxic else [])
        toxic += g.toxic
    assert toxic > 20
    # a text doesn't become toxic by being long
    long = toxicity.Scorer(none)(pa.array(["plain words " * 500_000]))[0][0]
    assert abs(long) < 0.1


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(4)
    lv, y = rng.integers(0, toxicity.LEVELS + 1, (toxicity._KINDS, 12)).astype(np.int8), rng.integers(0, 2, 12).astype(float)
    of, w = np.array([0, 7, 7, 12]), rng.normal(size=toxicity._N + 4) / 2

    def log_likelihood(w):
        e, t = toxicity._emissions(lv, w[: toxicity._N]), w[toxicity._N :]
        weigh = lambda lab, a: sum(e[a + i] * v for i, v in enumerate(lab)) + sum(t[int(2 * u + v)] for u, v in zip(lab, lab[1:]))
        return sum(weigh(y[a:z], a) - np.log(sum(np.exp(weigh(lab, a)) for lab in itertools.product((0, 1), repeat=z - a))) for a, z in zip(of, of[1:]))

    g = toxicity._gradient(lv, y, of, w[: toxicity._N], w[toxicity._N :])
    for i in range(len(w)):
        d = np.zeros(len(w))
        d[i] = 1e-5
        assert abs((log_likelihood(w + d) - log_likelihood(w - d)) / 2e-5 - g[i]) < 1e-4


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.model(docs, labels.where("doc_id % 2 = 0"))
    lab = labels.where("doc_id % 2 = 1").dropna().toPandas().set_index("doc_id")["toxic"]
    found = {r.doc_id for r in toxicity.score(docs, m).where("toxic").select("doc_id").collect()}
    said = lab.index.isin(found)
    assert (said & (lab == 1)).sum() / (lab == 1).sum() > 0.85 and (said & (lab == 0)).sum() / (lab == 0).sum() < 0.02


def test_sharding_against_sql_and_movement(spark, corpus):
    got = sharding.assign(make(spark, corpus)).select("doc_id", "region", "rack", "shard").collect()
    assert sorted(map(tuple, got)) == duck(sharding.sql(), corpus)
    old = sharding.TREE
    new = {**old, "r1": {**old["r1"], "k0": {**old["r1"]["k0"], "s0": 9.0}}}
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    moved = sharding.moved(many, old, new).collect()
    assert moved
    for r in moved:  # the one shard that grew only gains, and the rest move within subtrees that changed
        assert (r.region, r.rack, r.shard) == ("r1", "k0", "s0") or r.region == "r1"
    share = sharding.assign(many).groupBy("region").count().toPandas().set_index("region")["count"] / 4000
    total = sharding.weight_of(old)
    assert all(abs(share[r] - sharding.weight_of(old[r]) / total) < 0.03 for r in old)


# --- odd inputs -----------------------------------------------------------------------------


def test_odd_rows(spark):
    docs = odd(spark)
    n, bench = docs.count(), spark.createDataFrame([(1, None), (None, "a b c d e"), (2, ""), (3, "t1 t2 t3 t4 t5 t6")], "item_id long, text string")
    near = minhash_dedup.near_duplicates(docs).collect()
    assert sorted(r.doc_id for r in near) == [4, 4, 5] and sum(r.keep for r in near) == 1
    kept = minhash_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == n - 2
    assert {r.doc_id for r in suffix_dedup.repeated(docs).collect()} == {6}
    edited = line_dedup.drop_lines(docs)
    assert edited.columns == docs.columns and edited.count() == n
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()} == {(6, 3)}
    assert decontam.drop_contaminated(docs, bench).columns == docs.columns
    good = quality_rules.posteriors(docs).collect()
    assert len(good) == n and all(r.posterior == 0 for r in good if r.doc_id in (1, 2, 3))
    assert quality_rules.keep_good(docs).columns == docs.columns and suffix_dedup.drop_passages(docs).count() == n
    mixed = mixing.mix_documents(docs, share=1.0)
    assert mixed.columns == docs.columns and mixed.count() == n
    labels = spark.createDataFrame([(4, 1, 1), (6, 1, 0), (None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    m = toxicity.model(docs, labels)
    assert toxicity.score(docs, m).count() == n and toxicity.drop_toxic(docs, m).columns == docs.columns
    placed = sharding.assign(docs.withColumn("Shard", F.lit("old")))
    assert placed.count() == n and placed.where("region is null or rack is null or shard is null").count() == 0
    pages = spark.createDataFrame([(None, None, None), (1, "nonsense", ""), (1, "nonsense", ""), (2, "http://a/", "<p>" * 5000 + "deep"), (3, "http://a/", "<p>x" + "y " * 200_000)], "page_id long, url string, html string").withColumns({c: F.lit(c) for c in CLASH})
    assert html_extract.contents(pages).count() == 5
    turns = spark.createDataFrame([(None, None, None, None), (1, None, "user", "z " * 50_000), (1, 0, "user", "a"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string").withColumns({"ids": F.lit(1), "named": F.lit(2)})
    assert {r.conv_id: r.n_turns for r in chat_format.chats(turns).collect()} == {None: 1, 1: 3}


def test_empty_tables(spark):
    docs = odd(spark).where("false")
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (
        minhash_dedup.near_duplicates(docs), minhash_dedup.drop_near_duplicates(docs), suffix_dedup.repeated(docs), line_dedup.report(docs), decontam.contaminated(docs, bench), quality_rules.posteriors(docs),
        mixing.allocate(docs), toxicity.score(docs, toxicity.model(docs, labels)), sharding.assign(docs),
        html_extract.contents(spark.createDataFrame([], "page_id long, url string, html string")), chat_format.chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
    ):
        assert df.count() == 0
    full = odd(spark)
    assert decontam.contaminated(full, bench).count() == 0
    for df in (line_dedup.drop_lines(docs), suffix_dedup.drop_passages(docs), decontam.drop_contaminated(docs, bench), quality_rules.keep_good(docs), mixing.mix_documents(docs), toxicity.drop_toxic(docs, toxicity.model(docs, labels))):
        assert df.count() == 0 and df.columns == docs.columns
    assert decontam.drop_contaminated(full, bench).count() == full.count() == toxicity.drop_toxic(full, toxicity.model(full, labels)).count()
    assert toxicity.score(full, toxicity.model(full, labels)).where("toxic").count() == 0
