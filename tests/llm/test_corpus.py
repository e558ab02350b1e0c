"""Operators over whole corpora: near-dedup, mixing, repeats, vectors, packing, pages, pipeline."""

import hashlib
import math
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1])]
from corpus import frame, labels, odd_rows, prose, words  # noqa: E402

import corpus_pipeline  # noqa: E402
from histmetrics.llm import html_text, minhash, mixing, packing, suffixes, vectors  # noqa: E402
from histmetrics.llm import components as component_rounds  # noqa: E402
from histmetrics.llm.components import components  # noqa: E402


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_corpus():
    """Texts with exact copies, near copies, a shared passage, and unrelated ones."""
    rng, rows = random.Random(7), []
    shared = prose(rng, 30)
    for i in range(25):
        base = words(rng, rng.randint(60, 150))
        rows.append((len(rows), " ".join(base), f"s{i % 3}"))
        for _ in range(i % 4):
            copy = list(base)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(len(copy))] = rng.choice(words(rng, 3))
            rows.append((len(rows), "  ".join(copy), "s0"))
        if i % 5 == 0:
            rows.append((len(rows), shared + " " + prose(rng, 40), "s1"))
    return rows


def weighted_links(rows, threshold):
    bags = {}
    for i, t, _ in rows:
        w = (t or "").encode().split()
        bags[i] = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] * bool(w))
    held, n = Counter(s for b in bags.values() for s in b), len(rows)
    weight = {s: 1 + 0.5 * math.log((n + 1) / (d + 1)) / math.log(n + 1) for s, d in held.items()}
    links = []
    for a in bags:
        for b in bags:
            if a < b and bags[a] and bags[b]:
                both = sum(min(c, bags[b][s]) * weight[s] for s, c in bags[a].items())
                every = sum(c * weight[s] for x in (a, b) for s, c in bags[x].items()) - both
                if both / every >= threshold:
                    links.append((a, b))
    return links


def test_near_duplicates_match_brute_force(spark):
    rows = near_corpus()
    want = roots([i for i, _, _ in rows], weighted_links(rows, 0.8))
    got = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, rows, extra=True)).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (want[i] == i) for i, r in got.items())
    assert len(set(want.values())) < len(rows)


def test_dissimilar_members_of_a_bucket_meet(spark):
    # A common half puts many texts in one bucket of a band; only two of them are similar.
    rng = random.Random(8)
    common = prose(rng, 60)
    rows = [(i, common + " " + prose(rng, 50), "s") for i in range(30)]
    rows.append((30, rows[17][1] + " ka", "s"))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == roots(range(31), weighted_links(rows, 0.8))


def test_pairs_just_over_the_threshold_are_found_among_template_mates(spark):
    # Hundreds of texts on one template, below 0.8 to each other, and pairs just over it.
    rng = random.Random(21)
    template = words(rng, 400)
    rows = []

    def filled(number, base):
        text = list(base)
        for k in range(number):
            at = rng.randrange(len(text) - 12)
            text[at : at + 2] = words(rng, 2)
        return text

    for _ in range(300):
        rows.append(filled(5, template))
    for k in range(30):
        rows.append(filled(6, rows[k]))
    rows = [(i, " ".join(t), "s") for i, t in enumerate(rows)]
    want = roots(range(len(rows)), weighted_links(rows, 0.8))
    assert 25 < sum(want[i] != i for i in want) < 100
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == want


def test_sampling_estimates_weighted_similarity():
    rng = np.random.default_rng(9)
    hashes = rng.integers(0, 2**63, 400).astype(np.uint64)
    hashes.sort()
    one, two = rng.random(400) + 0.5, rng.random(400) + 0.5
    got = minhash.samples(np.concatenate([hashes, hashes]), np.concatenate([one, two]), np.array([0, 400, 800]))
    want = np.minimum(one, two).sum() / np.maximum(one, two).sum()
    assert abs((got[0] == got[1]).mean() - want) < 0.3


def test_rounds_of_few_links_write_one_file_each(spark, monkeypatch):
    files, cut = [], component_rounds.cut_lineage
    monkeypatch.setattr(component_rounds, "cut_lineage", lambda df: files.append(df.rdd.getNumPartitions()) or cut(df))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = spark.createDataFrame([(k, k + 1) for k in range(20)], "a long, b long").repartition(7)
        got = {r["node"]: r["root"] for r in components(links).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == dict.fromkeys(range(21), 0)
    assert len(files) > 2 and set(files) == {1}


def test_components_match_union_find(spark):
    rng = random.Random(10)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    nodes = sorted({x for e in links if e[0] != e[1] for x in e})
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == roots(nodes, links)


def brute_repeats(rows):
    last = 2**63 - 1
    first = {}
    for i, t, _ in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], last), last if i is None else i)
    out = []
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, dtype=int)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < (last if i is None else i):
                gone[k : k + 50] = 1
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.append(0, gone)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeats_match_brute_force(spark):
    rng = random.Random(11)
    passage, rows = prose(rng, 25), near_corpus()
    rows = [(i, t if i % 6 else t[:80] + passage + t[80:], s) for i, t, s in rows]
    rows += [(900, "a" * 400, "s"), (901, "b" + "a" * 120, "s"), (902, "ab" * 90, "s"), (903, "é" * 80, "s"), (904, "x" + "é" * 80, "s")]
    rows += [(i, t[:2000] if t else t, s) for i, t, s in odd_rows() if i != 5] + [(5, rows[0][1], "s"), (5, rows[0][1], "s"), (0, rows[3][1], "s")]
    got = suffixes.remove_repeats(frame(spark, rows, extra=True)).collect()
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted((tuple(r[c] for c in names) for r in got), key=repr) == brute_repeats(rows)


def test_column_wise_construction_sorts_suffixes(tmp_path):
    rng = np.random.default_rng(12)
    texts = [rng.integers(97, 99, rng.integers(50, 81)).astype(np.uint8) for _ in range(12)]
    texts += [texts[0][:60], np.full(70, 97, dtype=np.uint8)]
    built = suffixes.Columns(np.concatenate(texts), np.array([len(t) for t in texts]), str(tmp_path))
    transform, prefixes = built._split(built.pairs)
    # End marks sort by the number of their text, below every symbol.
    suffix = sorted((bytes(t[k:]), -1, n, k) for n, t in enumerate(texts) for k in range(len(t) + 1))
    suffix.sort(key=lambda s: ([*s[0]] + [-len(texts) + s[2] - 1], s[2]))
    assert [int(texts[n][k - 1]) if k else built.none for _, _, n, k in suffix] == transform.tolist()
    shared = [0]
    for (a, *_), (b, *_) in zip(suffix, suffix[1:]):
        shared.append(min(50, next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))))
    assert shared == prefixes.tolist()


def test_mix_reaches_targets(spark):
    rng = random.Random(13)
    rows = [(1000 + i, prose(rng, rng.randint(1, 60)), rng.choice(["a", "a", "a", "b", "c", "d", None, ""])) for i in range(300)] + odd_rows()
    got = mixing.mix_documents(frame(spark, rows, extra=True), block=64).collect()
    assert len(got) == len(rows)
    source = {r[0]: r[2] for r in rows}
    assert len(source) == len(rows) - 1
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, free = {}, set(order)
    while True:  # reshare what sources above twice their size cannot take
        level = (1.5 * sum(sizes.values()) - sum(want.values())) / max(1, sum(weight[s] for s in free))
        above = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not above:
            break
        want |= {s: 2.0 * sizes[s] for s in above}
        free -= above
    want |= {s: weight[s] * level for s in free}
    for s in order:
        assert math.isclose(target[s], want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert abs(taken[s] - want[s]) <= 1
    again = mixing.mix_documents(frame(spark, rows[::-1]), block=64).collect()
    plain = lambda found: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in found)
    assert plain(got) == plain(again)


def test_mixed_documents_hold_the_words_taken(spark):
    rng = random.Random(14)
    rows = [(i, prose(rng, rng.randint(5, 40)) + " \n", f"s{i % 4}") for i in range(60)]
    df = frame(spark, rows)
    got = mixing.mixed_documents(df, block=32)
    assert got.columns == df.columns
    words_of = Counter()
    for r in got.collect():
        words_of[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"]) and rows[r["doc_id"]][1].startswith(r["text"])
    want = {r["doc_id"]: r["taken"] for r in mixing.mix_documents(df, block=32).collect() if r["taken"]}
    assert dict(words_of) == want


def check_packing(found, width):
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= width
    return len(bins), -(-sum(r["length"] for r in found) // width)


def test_packing_is_whole_and_tight(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    rng = random.Random(15)
    rows = [(1000 + i, prose(rng, rng.randint(1, 500)), "s") for i in range(150)] + odd_rows()
    added = packing.ADDED
    rows += [(2000 + i, t, "s") for i, t in enumerate([added, f"a {added} b", f"x{added}{added}\n\n  y", added[:-1], f"é{added}ß", f"<|{added}"])]
    found = packing.pack_documents(frame(spark, rows, extra=True)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text, _ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        begin, piece = 0, 0
        for end in range(len(ids) % 1024 or 1024, len(ids) + 1, 1024):
            part = ids[begin:end]
            want[i, piece, begin, len(part), zlib.crc32(part.tobytes())] += 1
            begin, piece = end, piece + 1
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in found) == want
    used, least = check_packing(found, 1024)
    assert used <= least + 2


def test_fullest_combination_matches_brute_force():
    from itertools import product

    rng = random.Random(16)
    for _ in range(60):
        width = 30
        counts = {n: rng.randint(1, 3) for n in rng.sample(range(1, 31), 6)}
        lengths = sorted(counts, reverse=True)
        chosen = packing.fullest(lengths, counts, width)
        sums = [
            sum(n * k for n, k in zip(lengths, ks))
            for ks in product(*(range(counts[n] + 1) for n in lengths))
            if ks[0] >= 1
        ]
        best = max(s for s in sums if s <= width)
        assert sum(n * k for n, k in chosen.items()) == best
        assert chosen[lengths[0]] >= 1 and all(k <= counts[n] for n, k in chosen.items())


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(17)
    base = rng.normal(size=(40, 16))
    rows, seen = [], []
    for i, b in enumerate(base):
        for k in range(i % 6):
            rows.append((len(rows), [float(x) for x in b + (0.0 if k == 1 else 0.07) * rng.normal(size=16)], i % 2))
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] + [1.0] * 15, 1), (503, [], 1), (504, rows[3][1], None)]
    rows += [(505, [None, 1.0], 1), (506, [1e-30] * 16, 1), (507, [1e30] * 16, 1), (508, [1.0, 2.0], 1), (None, rows[2][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in vectors.near_vectors(df).collect()}
    links, count = [], Counter()
    usable = [(i, np.float32(v).astype(float), label) for i, v, label in rows if i is not None and v and label is not None and None not in v]
    usable = [(i, v, label) for i, v, label in usable if np.isfinite(v).all() and v.any()]
    for n, (a, va, la) in enumerate(usable):
        for b, vb, lb in usable[:n]:
            if la == lb and len(va) == len(vb):
                x, y = va / np.abs(va).max(), vb / np.abs(vb).max()
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links.append((a, b))
                    count[a] += 1
                    count[b] += 1
    want = roots([r[0] for r in rows if r[0] is not None], links)
    for i, root in want.items():
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (count[i], root, root == i), i
    assert got[None]["n_links"] == 0 and links and not seen


def test_dense_label_loses_no_pair(spark):
    # All of a label lie close together, below the threshold; planted pairs are just over it.
    rng = np.random.default_rng(22)
    base = rng.normal(size=64)
    base /= np.linalg.norm(base)

    def near(x, cosine, n):
        side = rng.normal(size=(n, 64))
        side -= (side * x).sum(axis=-1, keepdims=True) * x
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        return cosine * x + math.sqrt(1 - cosine**2) * side

    some = near(base, 0.95**0.5, 5000)
    x = np.concatenate([some, near(some[:150], 0.981, 150)]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in vectors.near_vectors(df).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = y @ y.T >= 0.98
    np.fill_diagonal(linked, False)
    assert 250 < linked.sum() < 3000
    want = roots(range(len(x)), list(zip(*(k.tolist() for k in np.nonzero(linked)))))
    for i, root in want.items():
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (linked[i].sum(), root, root == i), i


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header class="top"><p>%s</p></header><nav><ul><li><a href="/a">menu entry</a></li></ul></nav>
<div id="cookie-notice">We store things</div><div class="sidebar-3"><p>%s</p></div>
<div class="post post-%d"><h1>Title  of &amp; it</h1><p>First <b>bold</b>ed paragraph &lt;i&gt; %s<!-- hidden --><p>Second&nbsp;one
<ul><li>one<li>two</ul><div class="ad">Buy</div><form>Mail <input></form></div>
<div class="comments"><p>%s</p></div><footer>&copy; host</footer></body></html>"""


def test_pages_by_consensus(spark):
    rng = random.Random(18)
    filler = [prose(rng, 40) for _ in range(4)]
    rows = []
    for i in range(6):
        # On the last page the comments are longer than the article; the host's other pages outvote them.
        comment = filler[0] * (6 if i == 5 else 0)
        rows.append((i, f"https://u@h.example:80/p{i}", PAGE % ("x", "y", i, filler[1] + " " + filler[2], comment or "ok")))
    rows += [(6, None, None), (7, "no address", ""), (8, "http://plain.example", "only text &amp; no tags"), (8, "http://plain.example", "only text &amp; no tags")]
    rows += [(9, "http://long.example", "<article>" + "<p>word and word</p>" * 30000 + "</article>"), (None, "http://h.example/", "<p>unclosed <b>tags")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, row int")
    found = html_text.extract_pages(df).collect()
    got = {r["page_id"]: r for r in found}
    want = f"Title of & it First bolded paragraph <i> {filler[1]} {filler[2]} Second one one two"
    for i in range(6):
        assert got[i]["text"] == want
        assert got[i]["n_chars"] == len(want)
    assert got[6]["text"] == got[7]["text"] == "" and got[8]["text"] == "only text & no tags"
    assert got[9]["n_chars"] == 30000 * 14 - 1 and got[None]["text"] == "unclosed tags"
    assert len(found) == len(rows)
    assert html_text.extract_pages(df.where("false")).collect() == []


ARTICLE = "The council met on a long day to talk about the river and its banks. " * 6
SIDE = "<p>" + "Another text that stands beside it and is not short. " * 3 + "</p>"


@pytest.mark.parametrize("page", [
    '<div class="content no-sidebar"><p>%s</p></div>',
    '<div class="page-with-sidebar comments-enabled"><p>%s</p></div>',
    '<div class="elementor-widget"><div class="elementor-widget-container"><p>%s</p><div class="sidebar">' + SIDE + "</div></div></div>",
    '<div class="widget"><main><p>%s</p></main></div><div class="widget">' + SIDE + "</div>",
    '<div class="share-page"><article><p>%s</p></article><div class="related"><article>' + SIDE + "</article></div></div>",
    '<div class="text"><p>%s</p></div><div class="comments"><article class="comment-body">' + SIDE * 20 + "</article></div>",
    '<div class="text"><p>%s</p></div><div class="promo">' + SIDE * 5 + "</div>",
])
def test_class_words_do_not_take_the_article(page):
    assert html_text.Page("<html><body>" + page % ARTICLE + "</body></html>").extract("") == ARTICLE.strip()


def test_pages_of_notices_or_comments_alone_are_empty():
    for page in ('<div class="cookie"><p>We store small things.</p></div>', '<div class="comments">' + SIDE * 20 + "</div>"):
        assert html_text.Page(page).extract("") == ""


def test_the_winning_container_is_kept_whatever_its_name():
    page = '<div class="intro"><p>' + ARTICLE + '</p></div><div class="widget-7"><p>Short one.</p><div class="ad"><p>Buy</p></div></div>'
    assert html_text.Page(page).extract("/div.widget-0") == "Short one."


@pytest.mark.parametrize("run", [
    lambda d: minhash.near_duplicates(d),
    lambda d: mixing.mix_documents(d),
    lambda d: suffixes.remove_repeats(d),
    lambda d: packing.pack_documents(d),
    lambda d: mixing.mixed_documents(d),
    lambda d: minhash.keep_one(d),
], ids=["near", "mix", "repeats", "pack", "mixed", "keep_one"])
def test_odd_and_empty_tables(spark, run):
    assert run(frame(spark, [])).collect() == []
    assert run(frame(spark, odd_rows(), extra=True)).count() >= 5


def test_empty_vectors(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_pipeline_applies_every_stage(spark, tmp_path):
    rng, rows = random.Random(19), []
    for i in range(80):
        ws = words(rng, rng.randint(60, 90))
        rows.append((i, " ".join(w.upper() + "!!" for w in ws) if i % 4 == 0 else " ".join(ws), f"s{i % 3}"))
    rows += [(200, rows[1][1], "s1"), (201, rows[2][1] + " password=hunter2hunter2", "s2")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, [(i, int(i % 4 != 0), 0) for i in range(80)]).write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "pack":
            assert docs.columns == columns
    good = {i for i, _, _ in rows if i % 4 or i >= 200}
    assert {r["doc_id"] for r in seen["quality_rules"]} == good
    assert {r["doc_id"] for r in seen["near_dedup"]} == good - {200, 201}
    assert not any("hunter2" in r["text"] for r in seen["redact_secrets"])
    assert {r["doc_id"] for r in seen["pack"]} == {r["doc_id"] for r in seen["mix_sources"]}
    used, least = check_packing(seen["pack"], 1024)
    assert used <= least + 2
    plain = lambda found: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in found)
    assert plain(corpus_pipeline.run(spark, str(tmp_path)).collect()) == plain(seen["pack"])
