"""BPE, PII, chat, HTML and the classifiers."""

import hashlib
import json
import random
import re
import resource
import time
import tracemalloc
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegauge.llm import bpe, chat, pii, quality, toxicity
from tidegauge.llm import html_wrappers as H
from tidegauge.llm.queries import tokenizer_path
from tidegauge.llm.textbatch import code_points, flat, give_back, slices, word_hashes, words

TEXTS = ["", " ", "hello world", "It's   they'll\n\n\t x", "<|endoftext|>a<|endoftext|><|endoftext|>", "aaaaaaaaaaaa", "日本語 ½² é", "a\x1cb\x85c d 　", "x" * 5000, "no  space ", "\x00﻿"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library(spark, library):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate([*TEXTS, None, TEXTS[3]])], "doc_id long, text string, ids int").repartition(3)
    for r in bpe.roundtrip(df, tokenizer_path()).collect():
        text = [*TEXTS, None, TEXTS[3]][r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(df, tokenizer_path()), tokenizer_path())
    assert back.columns == ["doc_id", "text", "ids", "decoded"] and all(r.decoded == (r.text or "") for r in back.collect())
    assert bpe.roundtrip(df.where("doc_id < 0"), tokenizer_path()).count() == 0


@pytest.fixture(scope="module")
def own():
    return bpe.codec(tokenizer_path())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_bpe_on_any_text(library, own, texts):
    assert own.encode(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert own.counts(texts) == [len(x) for x in own.encode(texts)]


def test_bpe_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    own = bpe.codec(tokenizer_path())
    want = own.digests(TEXTS)
    assert own.digests(TEXTS) == want and len(own.ids_of) < 100


def test_lean_bpe_has_the_same_results_in_less_memory(spark, own):
    rnd = random.Random(6)
    vocab = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(2000)]
    texts = [" ".join(rnd.choices(vocab, k=8000)) for _ in range(100)]
    want, column = own.digests(texts), pa.array(texts, pa.string())
    tracemalloc.start()
    got = [x for _, part in bpe.text_slices(column, bpe.LEAN_CHARS) for x in own.digests(part)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == want and peak < 28 << 20
    rows = spark.createDataFrame(list(enumerate(texts[:30])), "doc_id long, text string").repartition(1)
    assert sorted(tuple(r)[1:] for r in bpe.roundtrip(rows, tokenizer_path(), lean=True).collect()) == sorted(want[:30])


def test_workers_give_freed_memory_back():
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * resource.getpagesize()

    held = [bytes(2000) for _ in range(100_000)]
    full = resident()
    held = held[::500]  # what stays lies all over the heap
    give_back()
    assert full - resident() > 120 << 20 and len(held) == 200


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"pre_tokenizer": None}, {"added_tokens": [{"id": 0, "content": "x", "lstrip": True}]}])
def test_other_files_than_byte_level_bpe_are_refused(change):
    spec = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}
    assert bpe.unsupported(spec) == [] and len(bpe.unsupported(spec | change)) == 1
    with pytest.raises(ValueError):
        bpe.Codec(json.dumps(spec | change).encode())


def test_decode_replaces_broken_utf8(library):
    own = bpe.codec(tokenizer_path())
    ids = own.encode(["é"])[0]
    assert own.decode([own.encode(["日"])[0][0]]) == library.decode([library.encode("日").ids[0]], skip_special_tokens=False)
    assert own.decode(ids) == "é"


def test_words_and_slices():
    texts = pa.array(["a b", None, "", " x\x0by ", "日本 語", "z" * 5000, "q" * 1500])
    got = []
    for first, last, buf, off in slices(texts, 16):
        s, e, cut = words(buf, off)
        assert len(cut) == last - first + 1 and len(word_hashes(buf, s, e)) == len(s)
        got += [buf[x:y].tobytes().decode() for x, y in zip(s, e, strict=True)]
        assert code_points(buf, off).tolist() == [len(t or "") for t in texts.to_pylist()[first:last]]
    assert got == [w for t in texts.to_pylist() for w in (t or "").split()]
    assert flat(pa.array([], pa.string()))[1].tolist() == [0]
    buf, off = flat(pa.array(["abc" * 600, "abc" * 599 + "abd", "abc" * 600]))
    h = word_hashes(buf, off[:-1], off[1:])
    assert h[0] == h[2] != h[1]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def brute_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    return {
        "email": [m.span() for m in EMAIL.finditer(t)],
        "ip": [m.span() for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15],
    }


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1290.@-+ ()%_é\n", max_size=60))
def test_base_spans_equal_the_patterns(t):
    assert pii.base_spans(t) == brute_spans(t)


@pytest.mark.parametrize("t", ["a@b@c.com", "@b.c@d.e x@y.z.", "1.2.3.4.5.6.7.8 0001.2.3.256", "4111 1111-1111 1111 4111111111111112", "+1 (555) 010-9999 + 12", "9" * 50_000, "a" * 50_000 + "@", "@" * 20_000])
def test_base_spans_on_hard_texts(t):
    assert pii.base_spans(t) == (brute_spans(t) if len(t) < 1000 else {k: [] for k in pii.BASE})


def test_pii(spark):
    texts = [
        "mail bob@example.com or call +1 555 010 9999", None, "", "card: 4111 1111 1111 1111, ip 10.0.0.1", 'password = "hunter2hunter2x"', "tel (030) 1234 5678 90",
        "version 1.2.3 page 12 clean text", "DE89 3704 0044 0532 0130 00 iban", "é bob@example.com",
    ] * 3
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(3)
    got = {r.doc_id: r for r in pii.digests(pii.find_spans(df)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = brute_spans(t or "")
        line = ",".join(f"{k}:{s}:{e}" for k in pii.BASE for s, e in base[k])
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(base[k]) for k in pii.BASE]
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and set(filter(None, line.split(","))) <= set(r.spans.split(","))
    assert "secret:12:27" in got[4].spans and got[6].spans == ""
    assert pii.find_spans(df.where("doc_id < 0")).count() == 0


def test_wide_patterns_take_whole_spans():
    def wide(t):
        return [(k, t[s:e]) for k, s, e, _ in pii.wide_spans(t, pii.base_spans(t))]

    jwt = "eyJ" + "a1B2" * 150 + "." + "c3D4" * 100
    assert wide(f"token: {jwt} end") == [("secret", jwt)]
    assert wide("call 555-867-5309 or 030-1234-5678.") == [("phone", "555-867-5309"), ("phone", "030-1234-5678")]
    assert wide("(030) 1234 5678 90") == [("phone", "(030) 1234 5678 90")] and wide("030/1234 5678") == [("phone", "030/1234 5678")]
    long = "x" * 100 + "(at)a(dot)b(dot)c.d.e.f.example.com"
    assert wide(f"to {long} now") == [("email", long)]
    for t in ("x" * 200_000 + "(at", "a(at)b" + " (dot) b" * 50_000, "token=" * 40_000, "555-" * 50_000):
        pii.wide_spans(t, pii.base_spans(t))


def test_expectation_maximisation_learns_reliabilities():
    good, bad = (2, 2, 2, 2, 1, 1), (1, 0, 0, 1, 0, 0)
    codes = np.array([pii.encode("card", good, (1, 2)), pii.encode("card", bad, (1, 2)), pii.encode("phone", (1, 1, 2, 2, 1, 1), (1, 1))])
    p = pii.reliabilities(codes, np.array([50, 80, 20]))
    assert p[0] > 0.95 and p[1] < 0.05 and p[2] > 0.5
    assert [pii.parts(int(c))[1] for c in codes[:2]] == [list(good), list(bad)]


def planted_spans(seed=0, n=600):
    """Sentences with national phone numbers, IBANs and secrets, and as many with numbers and tokens that are something else."""
    rnd = random.Random(seed)
    digits = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    token = lambda k: "".join(rnd.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMN0123456789") for _ in range(k)) + "7x"
    filler = lambda: " ".join(rnd.choice(["the", "river", "opens", "quiet", "stone", "under", "morning"]) for _ in range(rnd.randint(8, 15)))

    def luhn_number(good):
        while True:
            x = "4" + digits(15)
            if pii.luhn(x) == good:
                return x

    def iban():
        body = digits(18)
        return f"DE{98 - int(body + '131400') % 97:02}{body}"

    rows = []
    for i in range(n):
        kind, text, span = rnd.choice([
            lambda: ("phone", "please phone or fax ", f"(0{rnd.randint(30, 89)}) {digits(4)} {digits(4)}"),
            lambda: ("iban", "bank account IBAN ", iban()),
            lambda: ("secret", "the api_key = ", token(24)),
            lambda: ("email", "contact mail ", f"{token(6)} (at) example (dot) com"),
            lambda: ("", "order invoice no ", luhn_number(False)),
            lambda: ("", "version serial ", luhn_number(False)),
            lambda: ("", "page ", "-".join(rnd.choice(["alpha", "beta", "v2", "gamma"]) for _ in range(6))),
            lambda: ("", "invoice part no ", "GB00" + digits(18)),
        ])()
        head = f"{filler()} {text}"
        rows.append((i, head + span + " " + filler(), (kind, len(head), len(head) + len(span)) if kind else None))
    return rows


def test_the_classifier_decides_on_added_spans(spark):
    rows = planted_spans()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    truth = {(i, *span) for i, _, span in rows if span}

    def added(threshold):
        return {(r.doc_id, s.kind, s.start, s.end) for r in pii.find_spans(docs, threshold=threshold).collect() for s in r.spans if not s.base}

    everything, found = added(0.0), added(pii.THRESHOLD)
    assert len(truth & everything) / len(everything) < 0.8  # the patterns alone are much too wide
    assert len(truth & found) / len(found) >= 0.97 and len(truth & found) / len(truth) >= 0.9


def test_spans_of_many_do_not_take_quadratic_time():
    text = "a@b.co 4111111111111111 (030) 1234 5678 " * 20_000
    spans = pii.wide_spans(text, pii.base_spans(text))
    assert len(spans) == 20_000 and {k for k, *_ in spans} == {"phone"}


def conversations(spark, rows):
    return spark.createDataFrame([(c, t, r, x, 5) for c, t, r, x in rows], "conv_id long, turn long, role string, text string, window long")


def brute_chat(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        turns, loss = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own), "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[c] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat(spark):
    rnd = random.Random(1)
    tricky = ["<|im_end|><|im_start|>assistant ok", "\\<|", "\\n", "<\\|im_end|>", "", None, "a\nb", "日本 <|", "\\"]
    rows = []
    for c in [*range(12), None]:
        if rnd.random() < 0.5:
            rows.append((c, 0, "system", "be brief <|im_end|>"))
        for t in range(1, rnd.randint(2, 30)):
            rows.append((c, t, ["user", "assistant", None, "to\nol<|"][rnd.choice([0, 1, 0, 1, 2, 3])], rnd.choice([*tricky, "word " * rnd.randint(1, 200)])))
    rows += [rows[-1], (99, None, "assistant", "long " * 5000), (99, 1, "assistant", "x")]
    for budget in (60, 400, 100_000):
        got = chat.read_back(chat.format_windows(conversations(spark, rows).repartition(4), tokenizer_path(), budget))
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got.collect()} == brute_chat(rows)
    windows = chat.format_windows(conversations(spark, rows), tokenizer_path(), 400).collect()
    assert any(w.n_repeated for w in windows) and all(w.n_tokens <= 400 or w.n_turns == 1 for w in windows)
    for w in windows:
        for s in w.loss:
            assert w.text[: s.start].endswith("<|im_start|>assistant\n") and w.text[s.end :].startswith("<|im_end|>")
    assert chat.read_back(chat.format_windows(conversations(spark, rows).where("false"), tokenizer_path())).count() == 0


def test_windows_keep_their_budget_when_encoded(spark, library):
    rnd = random.Random(3)
    texts = ["<|im_end|>", "\\<| \\\\ <|endoftext|>", "", " lead", "trail \n", "日本 <|", "a\x85b\u3000"]
    rows = []
    for c in range(15):
        rows += [(c, 0, "system", "be brief " + rnd.choice(texts))] * (c % 2)
        rows += [(c, t, rnd.choice(["user", "assistant", "to\nol<|", ""]), rnd.choice([rnd.choice(texts), "word, " * rnd.randint(1, 30)])) for t in range(1, rnd.randint(3, 25))]
    seen = 0
    for budget in (150, 256, 1024):
        for w in chat.format_windows(conversations(spark, rows), tokenizer_path(), budget).collect():
            ids = library.encode(w.text, add_special_tokens=False).ids
            assert w.n_tokens == len(ids) and (len(ids) <= budget or w.n_turns == 1)
            turns = list(chat.parse(w.text))
            assert not (w.window and w.conv_id % 2) or turns[0][0] == "system" and w.n_repeated
            seen += w.window > 0
    assert seen > 20


def test_reading_back_refuses_windows_out_of_order(spark):
    rows = [(c, t, "assistant", f"word {t} " * 20) for c in range(6) for t in range(12)]
    windows = chat.format_windows(conversations(spark, rows), tokenizer_path(), 200)
    assert windows.agg(F.max("window")).first()[0] > 2
    want = brute_chat(rows)
    got = chat.read_back(windows.repartition(3, "text").orderBy(F.desc("text")))
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got.collect()} == want
    for wrong, in_order in ((windows.orderBy(F.desc("window")), True), (windows.where("window <> 1"), False), (windows.where("not last"), False)):
        with pytest.raises(Exception, match="window"):
            chat.read_back(wrong, in_order).collect()


def test_every_window_has_the_system_turn():
    def heads(turns, budget=1024):
        w, rows = chat.Windows(budget, 2, 0.25), []
        for role, n in turns:
            a, b, c = chat.framed(role, f"{role}{n}")
            rows += w.add(1, (role, a + b + c, len(a), len(a) + len(b), n))
        rows += w.flush()
        return [([r for r, _ in chat.parse(x[7])][: x[4]], x[5], x[6]) for x in rows]

    assert heads([("system", 60), ("user", 700), ("assistant", 200), ("user", 900), ("assistant", 30)]) == [([], 3, 960), (["system"], 2, 990)]
    assert heads([("system", 60), ("user", 800), ("assistant", 50), ("user", 150), ("assistant", 830)]) == [([], 3, 910), (["system", "assistant"], 1, 260), (["system"], 1, 890)]
    assert heads([("system", 60), ("user", 900), ("assistant", 3000), ("user", 10)]) == [([], 2, 960), (["system"], 1, 3060), (["system"], 1, 70)]
    assert heads([("system", 600), ("user", 400), ("assistant", 400)]) == [([], 2, 1000), (["system"], 1, 1000)]
    assert heads([("user", 900), ("assistant", 100), ("user", 120), ("assistant", 950)]) == [([], 2, 1000), (["assistant"], 1, 220), ([], 1, 950)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<|>\\n im_end\n", max_size=30))
def test_escaping_is_reversible(t):
    assert chat.unescape(chat.escape(t)) == t and chat.START not in chat.escape(t) and chat.END not in chat.escape(t)
    assert list(chat.parse("".join(chat.framed(t, t)))) == [(t, t)]


PAGE = (
    '<html><head><title>T</title><script>var x="<p>no</p>";</script></head><body><nav><ul>{menu}</ul></nav><div class="ad">buy</div>'
    "<article><h1>Title {i}</h1>{body}</article><div class='comments'><p>me too</p></div><footer>&copy; f</footer></body></html>"
)


def page(i, paragraphs, items):
    return PAGE.format(i=i, menu="".join(f"<li><a href='{k}'>m{k}</a></li>" for k in range(items)), body="".join(f"<p>p{k} &lt;{i}&gt;\n <b>x</b></p>" for k in range(paragraphs)))


def test_html(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", page(i, i % 4, 1 + i % 3), "x") for i in range(20)]
    rows += [(90, None, None, "x"), (91, "http://h0.example/", "", "x"), (92, "nonsense", "plain &amp; text", "x"), (92, "nonsense", "plain &amp; text", "x"), (93, "http://deep.example/", "<div>" * 3000 + "deep", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = {r.page_id: r for r in H.extract(df).collect()}
    for i in range(20):
        assert got[i].text == "\n".join([f"Title {i}", *[f"p{k} <{i}> x" for k in range(i % 4)]]) and got[i].n_chars == len(got[i].text)
    assert [got[k].text for k in (90, 91, 92, 93)] == ["", "", "plain & text", "deep"] and H.extract(df).count() == len(rows)
    assert H.extract(df.where("false")).count() == 0
    shape = {r.host: r for r in H.infer_wrappers(df).collect()}
    assert shape["h0.example"].pages == 11 and "<article><h1>#</h1>(<p>#</p>)+</article>" in H.written_out(json.loads(shape["h1.example"].wrapper))


def test_wrappers_align_into_optional_and_repeated_groups():
    a, b = (H.expression(H.parse(x)) for x in ("<ul><li>1</ul><p>x", "<ul><li>1<li>2</ul><h2>y</h2><p>x<p>z"))
    assert H.written_out(H.merge(a, b)) == "<#root><ul>(<li>#</li>)+</ul>(<h2>#</h2>)?(<p>#</p>)+</#root>"
    many = H.fold([["h2", 0, []], ["p", 0, []]] * 5)
    assert [x[0] for x in many] == ["h2", "p"] and all(x[1] & 1 for x in many)


def test_extraction_of_other_layouts():
    get = H.main_text
    assert get('<header>Site</header><main><article><header><h1>T</h1></header><p>a<br>b</p><aside>s</aside></article><section class="comments"><p>c</section></main>') == "T\na b"
    assert get("<div class='sidebar'><p>side</div><div><p>body one</p><p>body <a href=x>two</a></p></div><form><p>f</form>") == "body one\nbody two"
    assert get('<div class="post with-comments"><article><p>a</article><section class="comments"><article class="comment"><p>c</article></section></div>') == "a"
    assert get("<article><p>unclosed <!-- gone --> tail") == "unclosed tail"


def test_texts_that_a_host_repeats_are_constants_of_its_wrapper(spark):
    note = "<p>Read our <b>terms</b> first</p>"
    body = lambda i: f"<p>one {i}</p>{note if i % 4 else ''}<p>two {i}</p>" + ("<div>Join us</div>" if i % 2 else "")
    rows = [(i, f"http://a.example/{i}", f"<article><h1>T {i}</h1>{body(i)}</article>") for i in range(12)]
    rows += [(20 + i, "http://b.example/", f"<article><h1>T</h1>{note}</article>") for i in range(8)]  # equal pages are one
    rows += [(30 + i, f"http://c.example/{i}", f"<article>{note}<p>c {i}</p></article>") for i in range(2)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(got[i] == f"T {i}\none {i}\ntwo {i}" for i in range(12))
    assert all(got[20 + i] == "T\nRead our terms first" for i in range(8)) and all(got[30 + i] == f"Read our terms first\nc {i}" for i in range(2))


class Brute(HTMLParser):
    """An independent reading of well-formed pages: the texts of all blocks with the names and classes above them."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.path, self.now, self.blocks = [], [], []
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        text = " ".join("".join(self.now).split())
        if text:
            self.blocks.append((list(self.path), text))
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in ("b", "a", "span"):
            return
        if tag == "br":
            self.now.append(" ")
            return
        self.end()
        self.path.append((tag, dict(attrs).get("class", "")))

    def handle_endtag(self, tag):
        if tag not in ("b", "a", "span", "br"):
            self.end()
            self.path.pop()

    def handle_data(self, data):
        self.now.append(data)

    def text(self):
        article = lambda path: next((k for k, (tag, _) in enumerate(path) if tag == "article"), None)
        element = lambda path: any(tag in ("nav", "aside", "footer", "form", "script", "style") for tag, _ in path)
        classed = lambda path: any(c in ("ad", "cookie-notice", "sidebar") for _, c in path)
        return "\n".join(t for path, t in self.blocks if article(path) is not None and not element(path) and not classed(path[article(path) + 1 :]))


def random_page(rnd):
    def words():
        return rnd.choice(["one", "two &amp; three", "&lt;b&gt; four", "fünf&nbsp;sechs", "a  b\n c", "x &copy y", "<b>bold</b>er", "br<br>eak", "<a href='>'>li>nk</a>", "<span class=\"nav\">span</span>"])

    def flow(depth, inside):
        out = []
        for _ in range(rnd.randint(1, 4)):
            kind = rnd.choice(["p", "div", "section", "ul", "h2", "aside", "ad", "script", "comment", "text"] + ["article"] * (not inside) * 2)
            inner = lambda: flow(depth + 1, inside or kind == "article") if depth < 4 else words()
            if kind in ("p", "h2"):
                out.append(f"<{kind}>{words()} {words()}</{kind}>")
            elif kind == "ul":
                out.append("<ul>" + "".join(f"<li>{words()}</li>" for _ in range(rnd.randint(1, 3))) + "</ul>")
            elif kind == "ad":
                out.append(f"<div class='{rnd.choice(['ad', 'cookie-notice', 'sidebar'])}'><p>{words()}</p></div>")
            elif kind == "script":
                out.append("<script>if (a < b) x = '<p>no</p>';</script>")
            elif kind == "comment":
                out.append("<!-- <p>no</p> > -->")
            elif kind == "text":
                out.append(words())
            else:
                out.append(f"<{kind}>{inner()}</{kind}>")
        return "".join(out)

    return f"<!DOCTYPE html><html><body><nav><ul><li>menu</li></ul></nav><article>{flow(0, True)}</article>{flow(1, False)}<footer>f</footer></body></html>"


def test_extraction_equals_an_independent_reading():
    rnd = random.Random(6)
    for _ in range(400):
        x = random_page(rnd)
        assert H.main_text(x) == Brute(x).text(), x


def test_constants_equal_counts_of_all_pages(spark):
    rnd = random.Random(8)
    pool = [f"notice {k}" for k in range(6)]
    rows = []
    for h in range(4):
        for i in range(rnd.choice([2, 7, 12])):
            body = "".join(f"<div class='x{k}'>{rnd.choice(pool[: 1 + h]) if rnd.random() < 0.8 else f'own {h} {i}'}</div>" for k in range(3))
            rows.append((h, i, f"<article><h1>t {h} {i}</h1>{body}<p>end {i}</p></article>"))
    df = spark.createDataFrame([(100 * h + i, f"https://h{h}.example/{i}", p) for h, i, p in rows], "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    for h, i, p in rows:
        own = [Brute(q).blocks for g, _, q in rows if g == h]
        kept = []
        for k, (_, text) in enumerate(Brute(p).blocks):
            slot = [k] if k in (0, 4) else [1, 2, 3]  # like siblings are one repeated group
            n = sum(any(blocks[j][1] == text for j in slot) for blocks in own)
            if not (n >= H.CONSTANT_PAGES and 2 * n > len(own)):
                kept.append(text)
        assert got[100 * h + i] == "\n".join(kept)


def test_the_wrapper_chooses_the_main_text_of_hosts_without_known_names(spark):
    page = lambda i: f"<body><div><div>The best prices in town, every day of the week, for everybody</div><div><h2>Title {i}</h2><p>body {i} goes on</p><p>and <a href=x>on {i}</a> and on</p></div><div><ul><li><a href='/{i}'>teaser {i}</a></li><li><a href='/{i + 1}'>teaser {i + 1}</a></li></ul></div><div><p>All rights are with their owners and will stay there</p></div></div></body>"
    df = spark.createDataFrame([(i, f"http://plain.example/{i}", page(i)) for i in range(9)], "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    assert all(got[i] == f"Title {i}\nbody {i} goes on\nand on {i} and on" for i in range(9))
    assert all(H.main_text(page(i)) != got[i] for i in range(9))  # the page alone doesn't tell


def test_wrappers_are_merged_in_a_tree(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", "<body>" + "".join(f"<{t}>x</{t}>" for k, t in enumerate(["h1", "h2", "ul", "p", "dl", "pre"]) if i >> k & 1) + "<article><p>y</article>") for i in range(64)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    labels = lambda e: {e[0], *(x for c in e[2] for x in labels(c))}
    few, many = ({r.host: (labels(json.loads(r.wrapper)), r.pages) for r in H.infer_wrappers(df, fan).collect()} for fan in (2, 1000))
    assert few == many and few["h1.example"] == ({"#root", "body", "h1", "h2", "ul", "p", "dl", "pre", "article", "#"}, 32)


@pytest.mark.parametrize("unit", ['<a "', "<div>", "</div>", "<div></x>", "<!--", "<!", "<", "<p class='", '<p class="a">', "<article>", "<div><article>", "<dl><dt>", "&amp", "<script>", "<a href='x'>", "class=", "<p a=b "])
def test_hostile_pages_take_linear_time(unit):
    page = "<p>start</p>" + unit * (1_000_000 // len(unit))
    start = time.process_time()
    H.main_text(page)
    assert time.process_time() - start < 5
    start = time.process_time()
    a, b = H.expression(H.parse(page)), H.expression(H.parse("<h1>x</h1>" + "".join(f"<{t}>" for t in ("dl", "section", "ul") for _ in range(3)) + page))
    H.merge(a, b)
    assert time.process_time() - start < 10


def test_broken_tags():
    get = H.main_text
    assert get("<article><p>a</p><p title=\"never closed>b</p><p>c</p></article>") == "a\nb\nc"
    assert get("<article><p>1 < 2 and <3</p>x <b") == "1 < 2 and <3\nx <b"
    assert get("<article><p title='a > b'>c</p></article>") == "c"


def test_extraction_loses_no_block_of_the_main_text():
    get = H.main_text
    assert get("<body><header>Site</header><div><section><p>one</p></section><section><p>two</p><ul><li><a href=x>link</a></ul></section></div><ul><li><a href=y>other</a></ul></body>") == "one\ntwo\nlink"
    assert get("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"
    assert get("<p>aside</p>" + "<div>" * 60 + "<article><p>deep</p></article>") == "deep"
    assert get("<main><article>text text</article></main><section class='more'><article>teaser</article></section>") == "text text"
    assert get("<main><h1>text</h1><p>more text</p></main><div><article>teaser</article></div>") == "text\nmore text"
    assert get("<main><p>x</p></main><article>the longer text</article>") == "x\nthe longer text"


def documents(spark, n=400):
    rnd = random.Random(0)
    rows, labels = [], []
    for i in range(n):
        good, bad = rnd.random() < 0.7, rnd.random() < 0.3
        w = [rnd.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(rnd.randint(5, 60))]
        if bad:
            w.insert(rnd.randrange(len(w)), rnd.choice(["Vile!", "rotten"]))
        rows.append((i, " ".join(w) + "." if good else "### ".join(w) + "$$$", 1))
        labels.append((i, int(good), int(bad)))
    rows += [(1000, None, 1), (1001, "", 1), (1002, "alpha " * 50_000, 1)]
    labels += [(0, labels[0][1], None), (None, 1, 1), (5000, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels[:n]}


@pytest.mark.parametrize(("operator", "which"), [(quality.classify, 0), (toxicity.classify, 1)])
def test_classifiers(spark, operator, which):
    import zlib

    docs, labels, truth = documents(spark)
    got = {r.doc_id: r for r in operator(docs, labels).collect()}
    assert len(got) == len(truth) + 3 and all(0 <= r.score <= 1 for r in got.values())
    out = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert np.mean([got[i].predicted == truth[i][which] for i in out]) > 0.95
    assert {i: r.score for i, r in got.items()} == {r.doc_id: r.score for r in operator(docs.repartition(5), labels).collect()}
    assert operator(docs.where("false"), labels).count() == 0
    assert operator(docs, labels.where("false")).count() == len(got)


def test_training_sample_is_bounded(spark):
    docs, labels, _ = documents(spark)
    from tidegauge.llm.training import labelled

    assert 20 < labelled(docs, labels, "toxic", 60).count() <= 60


def test_quality_filter_keeps_columns(spark):
    docs, labels, truth = documents(spark)
    kept = quality.accepted(docs, labels)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} >= {i for i, (q, _) in truth.items() if q}


def hostile(spark):
    """Documents with columns of every helper's name, ids that repeat and one very long text."""
    docs, labels, truth = documents(spark, 120)
    docs = docs.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("_id", "_label", "_text", "id", "label", "key", "quality", "toxic", "x")])
    return docs.union(docs.where("doc_id % 3 = 0")).union(docs.where("doc_id % 3 = 0").withColumn("text", F.concat("text", F.lit(" again")))), labels, truth


@pytest.mark.parametrize("operator", [quality.classify, toxicity.classify])
def test_classifiers_with_clashing_names_and_repeated_ids(spark, operator):
    docs, labels, _ = hostile(spark)
    got = operator(docs, labels)
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0


def test_training_sample_is_bounded_after_the_join(spark):
    from tidegauge.llm.training import labelled

    docs, labels, _ = documents(spark)
    many = docs.crossJoin(spark.range(40).withColumnRenamed("id", "_id")).select("doc_id", F.concat("text", F.col("_id").cast("string")).alias("text"), "_id")
    assert 0 < labelled(many, labels, "toxic", 20).count() <= 20
    assert labelled(many, labels, "toxic", 10**6).count() == labelled(docs, labels, "toxic", 10**6).count()


def test_features_on_the_driver_are_bounded(spark, monkeypatch):
    docs, labels, _ = documents(spark)
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, y: seen.append(sum(map(len, rows))) or toxicity.Weights(0.0, np.zeros(0, np.int64), np.zeros(0)))
    for most in (3_000, 1 << 30):
        toxicity.train(docs, labels, most_features=most)
    assert 1_500 < seen[0] <= 3_000 < seen[1]


def test_ftrl_equals_one_coordinate_at_a_time():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 30, rng.integers(0, 12))) for _ in range(80)]
    y = rng.integers(0, 2, 80).astype(float)
    got = toxicity.fit(rows, y, passes=3, seed=5)
    z, n, order = {}, {}, np.random.default_rng(5)

    def weight(i):
        penalty = 0.0 if i == "bias" else toxicity.L1
        if abs(z.get(i, 0.0)) <= penalty:
            return 0.0
        return -(z.get(i, 0.0) - np.sign(z.get(i, 0.0)) * penalty) / ((toxicity.BETA + n.get(i, 0.0) ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(3):
        for k in order.permutation(80):
            on = [*rows[k].tolist(), "bias"]
            w = {i: weight(i) for i in on}
            g = 1 / (1 + np.exp(-np.clip(sum(w.values()), -30, 30))) - y[k]
            for i in on:
                z[i] = z.get(i, 0.0) + g - ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / toxicity.ALPHA * w[i]
                n[i] = n.get(i, 0.0) + g * g
    want = {i: weight(i) for i in z if i != "bias" and weight(i)}
    assert got.bias == pytest.approx(weight("bias")) and dict(zip(got.places.tolist(), got.values, strict=True)) == pytest.approx(want)


def test_flattened_trees_equal_walks_of_single_rows():
    rng = np.random.default_rng(4)
    x = rng.random((300, 5))
    y = ((x[:, 0] > 0.4) ^ (x[:, 2] > 0.7)).astype(float)
    forest = quality.fit(x, y, trees=12, depth=3)
    for row, got in zip(x, forest.score(x), strict=True):
        margin = forest.base
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            margin += leaf[node - len(f)]
        assert got == pytest.approx(1 / (1 + np.exp(-margin)))
    assert ((forest.score(x) > 0.5) == y).mean() > 0.95


@pytest.mark.parametrize(("name", "operator", "accuracy", "auc"), [("quality", quality.classify, 0.99, 0.99), ("toxic", toxicity.classify, 0.98, 0.98)])
def test_held_out_accuracy(spark, name, operator, accuracy, auc):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = operator(docs, labels).where("held_out").join(labels, "doc_id").select("score", "predicted", F.col(name).alias("y")).toPandas()
    rank = got.score.rank()
    pos = got.y == 1
    area = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert (got.predicted == got.y).mean() >= accuracy and area >= auc
