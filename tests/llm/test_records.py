"""Operators that turn rows into records: scans, packing, extraction, tokens, chat."""

from __future__ import annotations

import hashlib
import html
import random
import re
import string
import zlib

import numpy as np
import pytest

from weftgraph.llm import ef_tokens, html_blocks, kk_packing, queries, reply_trees, secret_scan
from weftgraph.llm.common import tokenizer_file
from weftgraph.llm.wordcache import WordCache

AWKWARD = [None, "", " \n\t ", "x", "AKIA" + "Z" * 20, "token = '" + "a1" * 30 + "'", "ſecret: abcdefghijklmnop", "é😀 password=\"Zx9\" deadbeefdeadbeef00",
           "word " * 30000, "<|endoftext|> a", "a  b\n\n\nc", "日本語のテキスト", "secret: token: q8Zt7Lm2Xp4Rv9Ws1Kd6", "Zk3vQ9xT7bL2mN8pR4sW6yD1fH5jC0gA"]
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, start long, kind string"


def table(spark, texts, ids=None):
    rows = [(i if ids is None else ids[n], t, "s", "en", len(t or ""), -1, "k") for n, (i, t) in enumerate(zip(range(len(texts)), texts))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def hf():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(tokenizer_file(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_cache_gives_library_ids(hf, name):
    cache = WordCache(tokenizer_file(name))
    for text in [t or "" for t in AWKWARD] + ["it's they'll 'twas 12 345", "a\x0bb\x1cc", "trail  ", "İstanbul ﬁ", "--'re !!'s"]:
        assert np.frombuffer(cache.encode(text), "<u4").tolist() == hf[name].encode(text, add_special_tokens=False).ids


def plain_scan(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m.group(2)) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(out)


def test_secret_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df in (table(spark, AWKWARD), docs):
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        for r in secret_scan.scan(df).collect():
            base = plain_scan(texts[r["doc_id"]])
            shown = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in base)
            assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(b[1] == k for b in base) for k in range(3))
            assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
            assert set(shown.split(",")) <= set(r["spans"].split(",")) or not shown
    assert secret_scan.scan(table(spark, [])).count() == 0


def test_random_strings_and_exclusions(spark):
    rows = {r["doc_id"]: r["spans"] for r in secret_scan.scan(table(spark, AWKWARD)).collect()}
    assert rows[13] == "random:0:32" and "assign" not in rows[12]
    enc = secret_scan._encoding(tokenizer_file("byte_bpe_50k.tiktoken"))
    for known in ("D41D8CD98F00B204E9800998ECF8427E", "123E4567-E89B-12D3-A456-426614174000", "some_long_identifier_name_2024", "internationalization-of-things"):
        assert not secret_scan.is_random(known, enc)


CHEAP = ("https/download/internal/documents/archive/session/", "/home/service/configuration/production/credentials/", "authorization_bearer_header_value=")


@pytest.mark.parametrize("ahead", CHEAP)
@pytest.mark.parametrize("digits", [True, False])
def test_cheap_words_do_not_hide_random_strings(ahead, digits):
    enc = secret_scan._encoding(tokenizer_file("byte_bpe_50k.tiktoken"))
    rng = random.Random(7)
    letters = string.ascii_letters + (string.digits if digits else "")
    found = 0
    for k in range(200):
        key = "".join(rng.choice(letters) for _ in range(20 + k % 20))
        text = f"see {ahead}{key}/archive/documents end"
        at = text.index(key)
        spans = secret_scan.all_spans(text, [], enc)
        found += any(s <= at and at + len(key) <= e for s, _, e in spans)
    assert found >= 195


def test_ordinary_runs_hold_no_random_parts():
    enc = secret_scan._encoding(tokenizer_file("byte_bpe_50k.tiktoken"))
    for run in ("getElementsByClassNameAndIdentifier", "docs/reference/2024/05/17/release-notes-v2", "src/components/UserProfile/index_test_helpers2",
                "files/123e4567-e89b-12d3-a456-426614174000/documents/archive/internal", "="*40, "application_configuration_production_eu-west-1"):
        assert secret_scan.all_spans(run, [], enc) == [], run


def test_redact_keeps_rows_and_columns(spark):
    df = table(spark, AWKWARD)
    out = {r["doc_id"]: r for r in secret_scan.redact(df).collect()}
    assert len(out) == len(AWKWARD) and secret_scan.redact(df).columns == df.columns
    assert out[0]["text"] is None and out[3]["text"] == "x" and out[4]["text"] == "[SECRET]" and out[4]["n_chars"] == 8
    assert not any(plain_scan(r["text"]) for r in out.values())


def test_differencing_balances():
    rng = np.random.default_rng(3)
    for k in (1, 2, 7, 30):
        w = rng.integers(1, 512, 400).tolist()
        parts = kk_packing.differencing(w, k)
        assert sorted(i for _, m in parts for i in m) == list(range(400))
        assert all(s == sum(w[i] for i in m) for s, m in parts)
        assert k == 1 or parts[-1][0] - parts[0][0] <= 64
    assert all(s <= 2048 for s, _ in kk_packing.split_group([1500, 1500, 1500, 600], 2048))


def test_packing_round_trip(spark, hf):
    tok = hf["byte_bpe_50k.json"]
    df = table(spark, AWKWARD + AWKWARD[:3])
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    rows = kk_packing.pack(df, with_ids=True).collect()
    got, sequences = {}, {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for i, t in texts.items():
        ids = tok.encode(t, add_special_tokens=False).ids + [1]
        pieces = sorted(got[i], key=lambda r: r["start"])
        assert [x for r in pieces for x in r["ids"]] == ids
        for r in pieces:
            assert r["doc_tokens"] == len(ids) and r["length"] == len(r["ids"])
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
            assert r["ids"] == ids[r["start"] : r["start"] + r["length"]]
    for s in sequences.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == np.cumsum([0] + [r["length"] for r in s[:-1]]).tolist()
        assert sum(r["length"] for r in s) <= 2048
    assert kk_packing.pack(table(spark, [])).count() == 0


def test_packing_padding(spark, sf_dir):
    rows = queries.op3_packing(spark, sf_dir).groupBy("sequence_id").sum("length").collect()
    total = sum(r[1] for r in rows)
    assert sum(2048 - r[1] for r in rows) < 0.03 * total


def test_extraction_of_given_pages(spark, sf_dir):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.op4_html(spark, sf_dir).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]]["html"], re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:h1|p|br)>", article)]
        assert r["text"] == " ".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


LONG = "Some words of a paragraph that go on for a while and tell of nothing in particular, well past twenty words in all of it."


def test_extraction_without_article_elements(spark, sf_dir):
    tree = html_blocks.train()
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        bare = re.sub(r"</?article>", "", r["html"])
        assert bare != r["html"] and html_blocks.main_text(bare, tree) == html_blocks.main_text(r["html"], tree)


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<p>", ""), ("<html><body><nav><a href=x>a</a></nav>", ""),
    ("<body><article><h1>T &amp; U</h1><p>One\n two<p>caf&eacute; &lt;b&gt;</article>", "T & U One two café <b>"),
    ('<article><p>a<b>b</b> c</p><div class="share-bar">Share</div><section id="comments"><p>reader words here</p></section><p>end</p></article>', "ab c end"),
    ('<aside>side</aside><main><script>var x="</p>";</script><p>body text</p><form><label>q</label></form><style>p{}</style></main><footer>f</footer>', "body text"),
    ('<div class="cookie-notice">We use cookies on this site for many things</div><article><p>Text</p></article><div class="ad">Buy now</div><!-- <p>no</p> --><p>x', "Text"),
    ('<body><div id="nav"><a>x</a></div><div class="post-content"><h2>Hi</h2><p>Short.</p></div><div>Copyright and other words that stand here on their own for long</div>', "Hi Short."),
    ('<div id="content"><p>outer</p><article><p>inner</p></article></div>', "inner"),
    ('<article><p class="notice">Note<p>kept<p class=ad>no</article>', "kept"),
    ('<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>', "one two a b"),
    (f'<article><div class="entry-header"><h1>Title</h1></div><p>{LONG}</p></article>', f"Title {LONG}"),
    (f'<article><section class="social-policy"><p>{LONG}</p></section></article>', LONG),
    (f'<main><p>{LONG}</p><div id="related-work"><h2>Related work</h2><p>{LONG}</p></div></main>', f"{LONG} Related work {LONG}"),
    (f'<article class="toc-free search-results"><p>{LONG}</p></article>', LONG),
    (f'<article><p>A teaser.</p></article><div><h2>The text</h2><p>{LONG}</p><p>{LONG}</p></div>', f"A teaser. The text {LONG} {LONG}"),
    (f'<article><h1>T</h1><p>{LONG}</p><div class="comment-list"><p>{LONG}</p></div></article>', f"T {LONG}"),
    (f'<article><h1>T</h1><p>{LONG}</p><ul><li><a>Mail</a></li><li><a>X</a></li><li><a>Y z</a></li></ul></article>', f"T {LONG}"),
    (f'<div><a href=x>Home</a></div><div><a href=y>About</a></div><div><h1>T here</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div><a href=z>More</a></div>', f"T here {LONG} Short. {LONG}"),
    ("<article><p>cut off in a tag <a hre", "cut off in a tag"), ("<article><p>ends in &am", "ends in &am"),
])
def test_extraction_cases(page, text):
    assert html_blocks.main_text(page or "", html_blocks.train()) == text


def test_extraction_tree_and_edges(spark):
    tree = html_blocks.train()
    table_ = np.array(html_blocks.LABELLED)
    right = np.mean([html_blocks.classify(tree, tuple(r[:-1])) == bool(r[-1]) for r in table_])
    assert right >= 0.95
    # Held-out rows: every fifth left out of training. (The given pages are held out as a whole.)
    for k in range(5):
        t = html_blocks.train([r for i, r in enumerate(html_blocks.LABELLED) if i % 5 != k])
        out = [r for i, r in enumerate(html_blocks.LABELLED) if i % 5 == k]
        assert np.mean([html_blocks.classify(t, tuple(map(float, r[:-1]))) == bool(r[-1]) for r in out]) >= 0.95
    df = spark.createDataFrame([(1, None, None, 5), (1, "u", "<article><p>a</article>", 5), (None, "u", "<article><p>a</article>", 5)], "page_id long, url string, html string, text long")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_blocks.extract(df).collect()) == [(0, "a", 1), (1, "", 0), (1, "a", 1)]


def test_elias_fano():
    rng = np.random.default_rng(1)
    for values in ([], [0], [5], [0, 0, 0], sorted(rng.integers(0, 10**6, 1000).tolist()), np.cumsum(rng.integers(1, 900, 3000)).tolist(), [1, 10**9]):
        ef = ef_tokens.EliasFano.build(np.array(values, dtype=np.int64))
        assert (ef.select(0, len(values)).tolist() if values else []) == values and [ef.select(i) for i in range(0, len(values), 7)] == values[::7]
    big = ef_tokens.EliasFano.build(np.cumsum(rng.integers(1, 900, 30000)))
    assert 8 * (big.low.nbytes + big.high.nbytes) < 13 * 30000


def test_token_files(spark, hf):
    tok = hf["word_bpe_49k.json"]
    df = table(spark, AWKWARD * 2, ids=[100 - i if i else None for i in range(2 * len(AWKWARD))])
    rows = ef_tokens.token_output(df, file_ids=5000).collect()
    texts = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda x: (x[0] is not None, x[0]))
    rows.sort(key=lambda r: r["start"])
    at = 0
    for (i, t), r in zip(texts, rows, strict=True):
        ids = tok.encode(t, add_special_tokens=False).ids + [1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    assert ef_tokens.token_output(table(spark, [])).count() == 0


def test_chat_against_brute_force(spark, sf_dir):
    convs = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        convs.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    convs[-7] = [(0, "user", queries.PROBE), (1, "assistant", queries.PROBE)]
    rows = queries.op9_chat(spark, sf_dir).collect()
    assert len(rows) == len(convs)
    for r in rows:
        turns = sorted(convs[r["conv_id"]])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_edge_cases(spark):
    rows = [(1, 0, "user", None, 9), (1, 1, "assistant", "a\\|<|im_end|> <s>[INST]\\", 9), (1, 1, "assistant", "a\\|<|im_end|> <s>[INST]\\", 9), (1, 2, None, "<<|im_sep|>", 9),
            (None, 0, "assistant", "x\ny😀", 9), (3, None, "as<|x", "<", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth long")
    out = {r["conv_id"]: r for r in reply_trees.chat(df).collect()}
    t = rows[1][3]
    assert out[1]["n_turns"] == 4 and out[1]["turns_sha256"] == hashlib.sha256(f"user\n\nassistant\n{t}\nassistant\n{t}\n\n<<|im_sep|>\n".encode()).hexdigest()
    assert out[1]["loss_sha256"] == hashlib.sha256((t + t).encode()).hexdigest()
    assert out[None]["loss_chars"] == 4 and out[3]["turns_sha256"] == hashlib.sha256(b"as<|x\n<\n").hexdigest()
    assert reply_trees.chat(df.limit(0)).count() == 0


def test_best_paths_of_branching_trees(spark):
    #      1 -> 2 -> 4(.9)      10 -> 11 -> 12 -> ... -> 40 (a chain)
    #        -> 3(.2) -> 5(.1)  50 (a lone root), 60 whose parent is missing
    nodes = [("a", 1, None, 0.0), ("a", 2, 1, 0.0), ("a", 3, 1, 0.2), ("a", 4, 2, 0.9), ("a", 5, 3, 0.1)]
    nodes += [("b", i, i - 1 if i > 10 else None, None) for i in range(10, 41)] + [("c", 50, None, 1.0), ("d", 60, 7, 1.0)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, score double")
    got = {}
    for r in reply_trees.best_paths(df).collect():
        got.setdefault(r["tree"], []).append((r["depth"], r["node"]))
    assert sorted(got["a"]) == [(1, 1), (2, 2), (3, 4)] and len(got["b"]) == 31 and got["c"] == [(1, 50)] and got["d"] == [(1, 60)]
    # Equal scores: the longer path, then the smaller leaf.
    tie = spark.createDataFrame([("t", 1, None, 0.0), ("t", 2, 1, 1.0), ("t", 3, 1, 0.5), ("t", 4, 3, 0.5), ("t", 5, 3, 0.5)], df.schema)
    assert sorted(r["node"] for r in reply_trees.best_paths(tie).collect()) == [1, 3, 4]
