import hashlib
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from squigspark.llm import decontaminate, htmltext, packing, secrets, warc

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcXYZ éÉßİΣ'.,!<|>\n\t\x1c\x85\xa0_19日́ﬁ", max_size=40), max_size=5), st.sampled_from([3, 1000]))
def test_ids_are_the_tokenizers(texts, remembered):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    mine = packing._tokenizer(PATH, remembered)
    texts = [*texts, "<|endoftext|> it's we'll DON'T", "plain words, here. And there!"]
    for _ in range(2):
        for text, ids in zip(texts, mine.encode_many(pa.array(texts)), strict=True):
            assert ids.tolist() == t.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_best_fit(lengths):
    lengths = np.array(sorted(lengths, reverse=True), dtype=np.int64)
    at, offset = packing.best_fit_decreasing(lengths, 16)
    windows: list[int] = []
    for i, n in enumerate(lengths.tolist()):  # the same by looking at all open windows
        fits = [w for w, used in enumerate(windows) if used + n <= 16]
        assert offset[i] + n <= 16
        if fits:
            assert windows[at[i]] == max(windows[w] for w in fits) == offset[i]
        else:
            assert at[i] == len(windows) and offset[i] == 0
            windows.append(0)
        windows[at[i]] += n


def test_the_tokenizer_gets_few_chunks_at_once():
    mine = packing.ChunkTokenizer(PATH, 1 << 20)
    inner, sizes = mine.tokenizer, []

    class Counting:
        def encode_batch_fast(self, parts, **options):
            sizes.append(max(len(parts), max(p.count(" ") + 1 for p in parts)))
            return inner.encode_batch_fast(parts, **options)

    mine.tokenizer = Counting()
    words = [f"{'abcdefghij'[i % 10]}{chr(97 + i // 10 % 26)}{chr(97 + i // 260 % 26)}{chr(97 + i // 6760)}" for i in range(10_000)]
    text = " ".join([*words, *(f"{i}x" for i in range(10_000))])
    (ids,) = mine.encode_many(pa.array([text]))
    assert ids.tolist() == inner.encode(text, add_special_tokens=False).ids and max(sizes) <= 1 << 12


def test_packing(spark, tokenizer):
    texts = [(1, "some words here"), (2, None), (3, ""), (4, "long text " * 5000), (5, "short"), (5, "short"), (None, "no id"), *[(10 + i, "w " * (i * 37)) for i in range(40)]]
    docs = spark.createDataFrame([(*t, 0, 1) for t in texts], "doc_id long, text string, offset int, start int")
    rows = packing.pack(docs, packing.PackingConfig(PATH, shard_pieces=20)).collect()
    ids = {d: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4") for d, t in texts}
    assert sum(r.length for r in rows) == sum(len(ids[d]) for d, _ in texts)
    by: dict = {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(docs.limit(0), packing.PackingConfig(PATH)).count() == 0


def slow_base(text):
    out = []
    kinds = [
        ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    for k, (kind, pattern, ok) in enumerate(kinds):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if ok(m)]
    return [s for _, _, s in sorted(out)]


HEXES = "0123456789abcdef" * 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["token", "SECRET", "Api_Key", "apikey", "ſecret", "=", ":", " ", '"', "'", "abcdef", "abcde", "AKIA", "ABCDEFGHIJ0123456789", HEXES, "é", "x.y-z", "passwd", "password"]), max_size=14))
def test_base_findings(parts):
    text = "".join(parts)
    found = [f for f in secrets.find_secrets(text) if f.kind != "literal"]
    assert [f"{f.kind}:{f.start}:{f.end}" for f in found] == slow_base(text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('db_passwd = "Xk29fPq8Lm2z"', ["Xk29fPq8Lm2z"]),
        ("const KEY = 'a8F3kP0zQ1xW';\nconfig.apiSecret = KEY;", ["a8F3kP0zQ1xW"]),
        ('part = "a8F3kP0z"\nclient_secret = part + "Q1xW77pL"', ["a8F3kP0z", "Q1xW77pL"]),
        ("AUTH_TOKEN=9fK2mZx81LqP\nPATH=/usr/bin", ["9fK2mZx81LqP"]),
        ('{"private_key": "Zk39Qm1PxL8vT2"}', ["Zk39Qm1PxL8vT2"]),
        ("password: changeme", []),
        ("token_count = 123456789012", []),
        ("The secret: everybody knows that plain words are fine", []),
        ('name = "Xk29fPq8Lm2z"', []),
        # Lines after # are read like other comments: .env and YAML files keep their old values there.
        ('# secret_key = "a8F3kP0zQ1xW"', ["a8F3kP0zQ1xW"]),
        ("", []),
    ],
)
def test_literals(text, want):
    assert [text[f.start : f.end] for f in secrets.find_secrets(text) if f.kind == "literal"] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('see https://a.b/c db_pwd = "Xk29sdfQ8812zz"', ["Xk29sdfQ8812zz"]),
        ('ftp://host/x;y then http://b.c/d#e, auth_key = "a8F3kP0zQ1xW"', ["a8F3kP0zQ1xW"]),
        ('rm /tmp/* ; db_pwd = "Xk29sdfQ8812zz" ; ls /var/*/x', ["Xk29sdfQ8812zz"]),
        ('rm src/* ; db_pwd = "Xk29sdfQ8812zz" ; ls */x', ["Xk29sdfQ8812zz"]),
        ('x = 1 // db_pwd = "Xk29sdfQ8812zz"', ["Xk29sdfQ8812zz"]),
        ('/* old\n * private_key = "Zk39Qm1PxL8vT2"\n */ y = 2', ["Zk39Qm1PxL8vT2"]),
        ('KEY = "a8F3kP0zQ1xW" // KEY = "none of it"\nconfig.apiSecret = KEY', ["a8F3kP0zQ1xW"]),
        ('db_pwd = /* was shorter */ "Xk29sdfQ8812zz"', ["Xk29sdfQ8812zz"]),
        ("// see https://a.b/c and nothing else", []),
        ("//" * 40_000 + ' a // db_pwd = "Xk29sdfQ8812zz"' + "/a" * 40_000 + "+b" * 40_000, ["Xk29sdfQ8812zz"]),
    ],
)
def test_urls_paths_and_comments(text, want):
    assert [text[f.start : f.end] for f in secrets.find_secrets(text) if f.kind == "literal"] == want


def test_one_word_items_and_a_long_text():
    """Passages have a least length, bounds are held for some passages at a time, and items are verified where they may get better."""
    rng = np.random.default_rng(2)
    items = [(i, f"w{i}x") for i in range(1200)]
    index = decontaminate.Index(items, decontaminate.DecontaminationConfig(bounded_passages=700))
    words = rng.integers(0, 1300, 100_000)
    began = time.process_time()
    (found,) = decontaminate.Matcher(index).match(pa.array([" ".join(f"w{i}x" for i in words)]))
    assert time.process_time() - began < 10
    assert [m[0] for m in found] == list(range(1200)) and all(m[1:4] == (1.0, 1.0, 1.0) for m in found)
    first = {int(w): k for k, w in reversed(list(enumerate(words)))}
    assert all(m[4] <= first[int(index.ids[m[0]])] < m[4] + 32 for m in found)


SECRET = "Xk29sdfQ8812zz"


@pytest.mark.parametrize(
    "text",
    [
        f'cfg["db_pwd"] = "{SECRET}"', f"os.environ['AUTH_KEY'] = '{SECRET}'", f'cfg["a"]["db_pwd"] = "{SECRET}"', f'auth_key: str = "{SECRET}"', f'let authKey: &str = "{SECRET}";', f'auth_key = """{SECRET}"""', f"auth_key = r'{SECRET}'",
        f'K = "{SECRET}"\nauth_key = f"{{K}}"', f'const K="{SECRET}"; const authKey = `${{K}}`', f"DB_PWD ?= {SECRET}", f'{{"auth": {{"key": "{SECRET}"}}}}', f"auth:\n  key: {SECRET}\n  user: bob\nother: x1x2x3x4x5", f"<private_key>{SECRET}</private_key>",
        f"define('AUTH_KEY', '{SECRET}')", f'os.putenv("AUTH_KEY", "{SECRET}")', f'set_auth_key("{SECRET}")', f'client.setAuthKey("{SECRET}");', f'auth_key = \\\n  "{SECRET}"', f'auth_key = (\n  "{SECRET}"\n)', f'# auth_key = "{SECRET}"', f"#  AUTH_KEY={SECRET}", f'x = 1  # auth_key = "{SECRET}"',
    ],
)
def test_forms_of_assignment(text):
    assert [text[f.start : f.end] for f in secrets.find_secrets(text) if f.kind == "literal"] == [SECRET]


@pytest.mark.parametrize(
    "text",
    [
        f'colour["tint"] = "{SECRET}"', f'names: str = "{SECRET}"', f'print("auth", "{SECRET}")', f'show_auth_key("{SECRET}")', f'{{"auth": {{"user": "{SECRET}"}}}}', f"auth:\n  user: {SECRET}\nkey: {SECRET}", f"<name>{SECRET}</name>", f"<private_key>{SECRET}</other>",
        '# The token: a word in prose', "# auth_key = changeme", 'f"{K}"', f'K = "{SECRET}"\nname = f"{{K}}"', '"""auth_key = """', "auth_key = (", 'auth_key = [\n"abc"', f'"session": {{"id": "{SECRET}"}}',
    ],
)
def test_what_is_no_secret(text):
    assert [f for f in secrets.find_secrets(text) if f.kind == "literal"] == []


def test_parts_of_a_formatted_literal():
    text = 'HEAD = "Xk29sdfQ"\nauth_key = f"{HEAD}-8812zzPq"\nother_pwd = ("Ab12Cd34"\n    "Ef56Gh78")'
    assert [(text[f.start : f.end], f.name) for f in secrets.find_secrets(text)] == [("Xk29sdfQ", "auth_key"), ("-8812zzPq", "auth_key"), ("Ab12Cd34", "other_pwd"), ("Ef56Gh78", "other_pwd")]


HOSTILE_SOURCE = {
    "triples": "secret " + '"""' * 333_333, "braces": "secret " + "a:{" * 300_000, "indents": "secret\n" + "".join(" " * (i % 50) + f"k{i}:\n" for i in range(30_000)), "tags": "secret </" + "<a>aaaaaaa" * 90_000, "calls": "secret " + 'set("a","b"' * 90_000, "formats": 'secret = "Ab12Cd34"\n' + 'token = f"{secret}{token}"\n' * 30_000,
    "escaped": "secret " + '\\"' * 500_000, "opened": "secret " + '"' + '\\"' * 500_000, "comments": "secret " + "/*" * 500_000, "quotes": "secret " + '"' * 500_001 + "'" * 500_001,
    "commented": "secret " + '/* a */ x="aaaaaaaa1"\n' * 40_000, "doubled": 'token0 = "abcdefgh12"\n' + "".join(f"token{i + 1} = token{i} + token{i}\n" for i in range(20_000)), "grown": 'token = "abcdefgh12"\n' + 'token = token + "a1B2c3d4"\n' * 30_000,
    "segments": "secret " + "a/b" * 300_000, "blanks": "password" + " " * 900_000,
}


@pytest.mark.parametrize("name", sorted(HOSTILE_SOURCE))
def test_lexing_is_linear_in_the_text(name):
    began = time.process_time()
    secrets.find_secrets(HOSTILE_SOURCE[name])
    assert time.process_time() - began < 12


def test_constants_that_grow_stay_bounded():
    text = 'a0 = "Zk39Qm1PxL8vT2"\n' + "".join(f'a{i + 1} = a{i} + a{i} + "z{i}"\n' for i in range(40)) + 'my_token = a2\nits_token = a40 + "Xk29fPq8Lm2z"\n'
    found = {text[f.start : f.end]: f.name for f in secrets.find_secrets(text) if f.kind == "literal"}
    assert found["Zk39Qm1PxL8vT2"] == found["z0"] == "my_token" and found["Xk29fPq8Lm2z"] == "its_token"


def test_literals_against_construction():
    """Random sources whose secrets are known as they are made."""
    rng = np.random.default_rng(1)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    fresh = lambda: "a1B2" + "".join(rng.choice(letters, 16))
    for _ in range(200):
        text, want, constants = "", set(), []
        for n in range(12):
            value, kind, quote = fresh(), int(rng.integers(0, 7)), str(rng.choice(["'", '"']))
            if kind == 0:  # harmless
                text += f"colour_{n} = {quote}{value}{quote}\n"
            elif kind == 1:
                want.add(len(text) + len(f"db_pwd{n}: ") + 1)
                text += f"db_pwd{n}: {quote}{value}{quote},\n"
            elif kind == 2:  # a constant, maybe used later
                constants.append((f"part{n}x", len(text) + len(f"part{n}x = ") + 1))
                text += f"part{n}x = {quote}{value}{quote};\n"
            elif kind == 3 and constants:
                name, at = constants[int(rng.integers(0, len(constants)))]
                want.add(at)
                text += f"conf.privateKey = {name}\n"
            elif kind == 4 and constants:
                name, at = constants[int(rng.integers(0, len(constants)))]
                start = f"authKey{n} := {name} + "
                want |= {at, len(text) + len(start) + 1}
                text += f"{start}{quote}{value}{quote}\n"
            elif kind == 5:
                text += f"see https://h.example/{value} and /usr/{value}/* there\n"
            else:
                want.add(len(text) + len(f"// pwd{n}=") + 1)
                text += f"// pwd{n}={quote}{value}{quote}\n"
        got = {f.start for f in secrets.find_secrets(text) if f.kind == "literal"}
        assert got == want, text


def test_secrets_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "é token = abcdef1"), (3, "é token = abcdef1"), (None, "x"), (4, "a" * 300_000 + ' my_password="Xk29fPq8Lm2z"')]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, spans string, n_hex int")
    got = secrets.digests(docs).collect()
    assert len(got) == len(rows)
    assert got[0].spans == "" and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[2].n_assign == 1 and got[2].spans.split(",")[0] == "assign:2:17"
    assert got[2].base_sha256 == hashlib.sha256(b"assign:2:17").hexdigest()
    assert got[5].n_hex == 1 and "literal" in got[5].spans
    clean = secrets.redact(docs).collect()
    assert [r.text for r in clean[:2]] == [None, ""] and clean[2].text == "é [assign]" and clean[4].text == "x"
    assert "Xk29" not in clean[5].text
    assert secrets.scan(docs).first().findings == []
    assert secrets.digests(docs.limit(0)).count() == 0


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")


def test_archives(spark, tmp_path):
    body = "<html>" + "same words again " * 200
    rows = [(i, f"http://h/{i}", body + str(i % 7)) for i in range(60)] + [(100, None, None), (101, "u\r\nInjected: 1", ""), (None, "n", "only null id"), (5, "http://h/5", body + "5"), (102, "x", "é\r\n\r\nWARC/1.1\r\n\r\n")]
    made = warc.write_archives(pages(spark, rows), str(tmp_path))
    assert made.agg({"records": "sum"}).first()[0] == len(rows)
    got = warc.read_archives(made, payloads=True).collect()
    assert len(got) == len(rows)
    least: dict = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(least.get(h or "", i), i)
    texts = {(i, h or "") for i, _, h in rows}
    by_digest = {warc.payload_digest((h or "").encode()): h or "" for _, _, h in rows}
    for r in got:
        h = by_digest[r.payload_digest]
        assert (r.page_id, h) in texts and r.payload_bytes == len(h.encode())
        first = least.get(h)
        if r.page_id is None or r.page_id == first:
            assert r.record_type == "response" and r.refers_to is None and r.payload.decode() == h
        else:
            assert r.record_type == "revisit" and r.refers_to == first and r.payload == b""
    import struct

    head = next(tmp_path.glob("*.warc.zst")).read_bytes()[:4]
    assert struct.unpack("<I", head)[0] == warc.DICTIONARY_MAGIC
    assert warc.read_archives(warc.write_archives(pages(spark, rows).limit(0), str(tmp_path / "e"))).count() == 0


def test_short_payloads_are_never_revisits(spark, tmp_path):
    rows = [(1, "a", "tiny"), (2, "b", "tiny"), (3, "c", "long enough"), (4, "d", "long enough")]
    made = warc.write_archives(pages(spark, rows), str(tmp_path), warc.WarcConfig(least_bytes=5))
    assert {r.page_id: r.record_type for r in warc.read_archives(made).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_a_cut_archive_is_an_error(tmp_path):
    import io

    out = io.BytesIO()
    warc.write_file(iter([warc.Page(1, "u", b"text " * 99, None, False, None)]), out, b"", warc.WarcConfig())
    with pytest.raises(EOFError):
        list(warc.read_file(io.BytesIO(out.getvalue()[:-3])))


VOCAB = [f"{a}{b}" for a in "abcdefgh" for b in ("al", "en", "is", "or", "um")]


def items_and_docs(seed):
    rng = np.random.default_rng(seed)
    say = lambda n: [str(w) for w in rng.choice(VOCAB, n)]
    items = [(i, " ".join(say(int(rng.integers(8, 20)))).capitalize() + ". " + " ".join(say(int(rng.integers(1, 6)))) + ".") for i in range(25)]
    docs = []
    for i in range(60):
        words = say(int(rng.integers(0, 200)))
        if i % 3 == 0:
            at, t = int(rng.integers(0, len(words) + 1)), items[int(rng.integers(25))][1]
            words[at:at] = (t.upper() if i % 2 else t).split()
        docs.append((i, " ".join(words)))
    return items, docs


@pytest.mark.parametrize("seed", range(3))
def test_search_finds_all_above_the_threshold(seed):
    items, docs = items_and_docs(seed)
    index = decontaminate.Index(items, decontaminate.DecontaminationConfig(threshold=0.3, block_items=4))
    rng = np.random.default_rng(seed)
    for _ in range(200):
        terms = sorted(set(rng.integers(0, len(index.terms), int(rng.integers(1, 25))).tolist()))
        scores = np.zeros(len(index.ids))
        for t in terms:
            for item, x in index.postings[t]:
                scores[item] += x
        want = {int(i): float(scores[i]) for i in np.flatnonzero(scores >= 0.3)}
        assert dict(index.search(terms)) == pytest.approx(want)


@pytest.mark.parametrize("seed", range(3))
def test_matches_against_brute_force(spark, seed):
    items, docs = items_and_docs(seed)
    cfg = decontaminate.DecontaminationConfig()
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), cfg).collect()
    index = decontaminate.Index(items, cfg)
    weight = lambda i, t: dict(index.postings[index.terms[t]]).get(i, 0.0)
    want = set()
    for d, text in docs:
        words = decontaminate.words_of(text)
        for begin in range(0, max(1, len(words)), index.longest):
            passage = words[begin : begin + 2 * index.longest]
            for i in range(len(index.ids)):
                score = sum(weight(i, w) for w in set(passage) if w in index.terms)
                if score >= cfg.threshold and all(decontaminate.held_share(part[i], passage, 5) >= cfg.overlap for part in (index.question, index.answer)):
                    want.add((d, index.ids[i]))
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert {d for d, _ in want} >= {i for i in range(60) if i % 3 == 0}


def test_shards_change_nothing(spark):
    items, docs = items_and_docs(7)
    items += [(100, "xylophone " * 40 + "end."), (101, None), (102, "...")]
    docs += [(100, " ".join(w for _, t in items[:4] for w in t.split()))]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(tuple, decontaminate.matches(*tables, decontaminate.DecontaminationConfig(shard_chars=n)).collect())) for n in (1 << 20, 700))
    assert len(one) > 20 and one == many
    assert len(list(decontaminate.index_shards(tables[1], decontaminate.DecontaminationConfig(shard_chars=700)))) > 2


def test_decontamination_of_odd_rows(spark):
    items = spark.createDataFrame([(1, "The quick brown fox jumps over a lazy dog today. Yes indeed."), (2, None), (3, "..."), (1, "The quick brown fox jumps over a lazy dog today. Yes indeed.")], "item_id long, text string")
    leak = 'He said "the QUICK brown fox, jumps over a lazy dog today" -- yes indeed!'
    rows = [(1, leak), (1, leak), (2, None), (3, ""), (4, "the quick brown fox jumps"), (None, leak), (5, "pad " * 100_000 + leak), (6, "--- ... !!!")]
    docs = spark.createDataFrame([(*r, 3, 0.1) for r in rows], "doc_id long, text string, item_id int, score double")
    found = decontaminate.matches(docs, items).collect()
    assert sorted((r.doc_id or -1) for r in found if r.item_id == 1) == sorted([1, 1, 1, 1, -1, -1, 5, 5])
    left = decontaminate.without_matches(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 6]
    assert decontaminate.matches(docs, items.limit(0)).count() == 0
    assert decontaminate.matches(docs.limit(0), items).count() == 0
    small = decontaminate.DecontaminationConfig(shard_chars=10)
    assert sorted((r.doc_id or -1) for r in decontaminate.matches(docs, items, small).collect() if r.item_id == 1) == sorted([1, 1, 1, 1, -1, -1, 5, 5])


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>one<p>two <b>bold</b>\n text", "one\n\ntwo bold text"),
        ("<ul><li>a<li>b<ol><li>x<li>y</ol><li>c</ul>", "* a\n* b\n  1. x\n  2. y\n* c"),
        ("<ol start=3><li>a</li><li>b</li></ol>", "3. a\n4. b"),
        ("<table><tr><th>name<th>n<tr><td>long cell<td>7</table>", "name       n\nlong cell  7"),
        ("a<br>b<hr>c", "a\nb\n\nc"),
        ("<head><title>t</title><style>x</style></head><body>v<script>if (a<b) '</p>'</script>w", "vw"),
        ("x<div hidden>no</div><span style='display: none'>no</span><i style=\"color:red\">yes</i><p aria-hidden=true>no", "xyes\n\nno"),
        ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
        ("&lt;tag&gt; &amp; &eacute;&nbsp;z", "<tag> & é\xa0z"),
        ("<!-- c --><p>a</p></p></div>b<!-- open", "a\n\nb"),
        ("<dl><dt>t<dd>d</dl>", "t\n  d"),
        ("1 < 2 <", "1 < 2 <"),
        ("<h1>H</h1><div>a</div><div>b</div>", "H\n\na\nb"),
        ("", ""),
        (None, ""),
        ("<div>" * 3000 + "deep", "deep"),
        ("<table>" * 300 + "t", "t"),
        ("<a href='x>y'>in</a>", "in"),
        ('<p title="a hidden gem">visible</p><div class="flex hidden md">x</div>', "visible\n\nx"),
        ('<p data-x="style=display:none" style="color:red">seen<p style="a:b; display : none">not', "seen"),
        ("<dialog open>a</dialog><dialog>b</dialog><p HIDDEN=''>c", "a"),
        ("<textarea>a\n b</textarea>", "a\n b"),
        ("<select><option>a<option selected>b<option>c</select>", "b"),
        ("<select multiple><optgroup><option>a<option>b</select>", "a\nb"),
        ("<input value=typed><input type=hidden value=x><input type=submit value=Go>", "typedGo"),
        ("<svg><title>t</title><desc>d</desc><text>drawn</text></svg>", "drawn"),
        ("<table><tr><td>a<td>b<tr><td>" + "w" * 50 + "<td>c</table>", "a  b\n" + "w" * 50 + "  c"),
        ("&#" + "9" * 5000 + "; &#0000000065;", "\ufffd; A"),
        ("a<b", "a"),
    ],
)
def test_rendering(page, want):
    assert htmltext.render(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<div style="visibility:hidden">h<span style="visibility:visible">v</span></div>', "v"),
        ("<style>.x{display:none} p.y, #z { visibility : hidden }</style><p class='a x'>no<p class=y>no<div class=y>yes</div><p id=z>no", "yes"),
        ("<style>p{display:none} .seen{display:block} #never{display:none}</style><p>no<p class=seen>a<p class=seen id=never>no<p class=seen style='display:none'>no", "a"),
        ("<style>@media print { p { display:none } } /* p{display:none} */ a b{display:none}</style><p>a", "a"),
        ("<style media=print>p{display:none}</style><p>a", "a"),
        ("<style>b{visibility:hidden}</style><p>a<b>no<i style='visibility:visible'>yes</i></b>", "ayes"),
        ("<p hidden style='display:block'>a", "a"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<table><tr><td rowspan=3>a<td rowspan=2>b<td>c<tr><td>d<tr><td>e</table>", "a  b  c\n      d\n   e"),
        ("<table><tr><td colspan=2>wide<td>x<tr><td>aa<td>b<td>y</table>", "wide   x\naa  b  y"),
        ("<table><tr><td>a<td style='visibility:hidden'>b<td>c<tr><td>1<td>22<td>3</table>", "a      c\n1  22  3"),
        ("<ol><li value=5>a<li>b</ol>", "5. a\n6. b"),
        ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
        ("<ol reversed start=9><li>a<li value=3>b<li>c</ol>", "9. a\n3. b\n2. c"),
        ('<div style="white-space:pre">a  b\n c<p style="white-space:normal">d  e</p></div>', "a  b\n c\n\nd e"),
        ('<div style="white-space: pre-line">a  b\n c</div>', "a b\nc"),
        ("<details><summary>s</summary>no<p>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    ],
)
def test_style_spans_and_lists(page, want):
    assert htmltext.render(page) == want


def test_deep_tables_and_wide_spans_are_quick():
    began = time.process_time()
    assert htmltext.render("<table><tr><td>a<td>" * 66 + "x " * 400_000).count("x") == 400_000
    assert htmltext.render("<table><tr>" + "<td colspan=1000 rowspan=60000>a" * 3 + "<tr><td>b" * 50_000).count("b") == 50_000
    assert htmltext.render("<style>" + ".a{display:none}" * 50_000 + "</style>" + "<p class='b c d'>x" * 20_000).count("x") == 20_000
    assert time.process_time() - began < 10


def test_all_visible_words_stay():
    """Against the words of a plain tag stripper, on markup without hidden parts."""
    rng = np.random.default_rng(0)
    tags = ["p", "div", "li", "ul", "td", "tr", "table", "b", "i", "h2", "ol", "blockquote", "span", "dd"]
    for _ in range(200):
        parts = []
        for i in range(40):
            parts.append(str(rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", f" w{i} ", f" w{i} "])))
        page = "".join(parts)
        want = re.sub(r"<[^>]*>", " ", page).split()
        got = [w for w in htmltext.render(page).split() if w.startswith("w")]
        assert sorted(got) == sorted(want)


HOSTILE = {
    "tags": "<a " * 330_000, "quotes": '<a b="' * 160_000, "comments": "<!--" * 250_000, "titles": "<title " * 140_000, "amps": "&" * 1_000_000, "lists": "<ul><li>" * 300 + "x<br>" * 200_000, "styles": '<p style="' + ";" * 900_000 + '">x',
    "cells": "<table><tr>" + "<td>" * 3000 + "<td>" + "x<br>" * 3000, "wide": "<table>" + "<tr><td>a<td>b" * 20_000 + "<tr><td>" + "w" * 500_000 + "<td>x</table>", "less": "<" * 500_000, "blanks": "<a" + " =" * 500_000,
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_rendering_is_linear_in_the_page(name):
    page, began = HOSTILE[name], time.process_time()
    out = htmltext.render(page)
    assert time.process_time() - began < 10 and len(out) <= 20 * len(page)


def laid_out(rng, depth=0):
    """A random page and its layout, made together: (markup, lines, is a paragraph-like block)."""
    kind = rng.integers(0, 4 if depth < 3 else 2)
    word = "".join(rng.choice(list("abcdef"), 4))
    if kind == 0:
        return f"<p>{word}\n <i>{word}</i>", [f"{word} {word}"], True
    if kind == 1:
        rows = [["".join(rng.choice(list("xyz"), int(rng.integers(1, 9)))) for _ in range(3)] for _ in range(3)]
        wide = [max(len(r[i]) for r in rows) for i in range(3)]
        markup = "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in rows) + "</table>"
        return markup, ["  ".join(c.ljust(w) for c, w in zip(r, wide, strict=True)).rstrip() for r in rows], True
    inner = [laid_out(rng, depth + 1) for _ in range(2)]
    markup, lines = "".join(m for m, _, _ in inner), joined(inner)
    if kind == 2:
        return f"<div>{markup}</div>", lines, None if inner else False
    return f"<blockquote>{markup}</blockquote>", ["  " + x if x else x for x in lines], True


def joined(parts):
    """Paragraph-like blocks, and whatever a plain block begins and ends with, have a blank line around them."""
    out = []
    for _, lines, _ in parts:
        out += [""] * bool(out) + lines
    return out


def test_layout_against_construction():
    rng = np.random.default_rng(3)
    for _ in range(150):
        parts = [laid_out(rng) for _ in range(3)]
        assert htmltext.render("".join(m for m, _, _ in parts)) == "\n".join(joined(parts))


def test_pages_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "<p>a"), (3, "<p>a"), (None, "<title>T &amp; U</title>b"), (4, "<p>" + "word " * 100_000)]
    df = spark.createDataFrame([(*r, "t", 0) for r in rows], "page_id long, html string, text string, n_chars int")
    got = htmltext.page_texts(df).collect()
    assert [(r.page_id, r.title, r.text[:3], r.n_lines) for r in got] == [(1, "", "", 0), (2, "", "", 0), (3, "", "a", 1), (3, "", "a", 1), (None, "T & U", "b", 1), (4, "", "wor", 1)]
    assert htmltext.page_texts(df.limit(0)).count() == 0
