"""Pages and texts that the usual ones don't hold: layouts the training grammar doesn't draw, very long and broken inputs."""

import json
import time

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foreband.llm import extraction, mixing, secrets, tokens, topk

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega and so on"
ONE, TWO = f"First {WORDS} {WORDS}", f"Then it's {WORDS} {WORDS}"
WANT = f"Headline here\n{ONE}\n{TWO}"
BODY = f"<h1>Headline here</h1><p>{ONE}</p><p>{TWO}</p>"
AROUND = [
    "{}",
    "<nav><ul><li><a href=/>Home</a></li><li><a href=/b>More</a></li></ul></nav>{}<footer>&copy; us</footer>",
    "<header><a href=/>Site</a></header>{}<div class=cookie-notice><p>We use cookies here.</p></div>",
    '<div class="ad">Buy now</div>{}<section class="comments"><p>Nice one!</p></section>',
]
NAMES = ["information", "platform", "research-body", "inside", "navy", "stock-side", "formal", "adsorption", "shared", "sociology", "reformat"]


@pytest.fixture(scope="module")
def model():
    return extraction.train(extraction.labelled_pages())


@pytest.mark.parametrize("around", AROUND)
@pytest.mark.parametrize("name", NAMES)
def test_class_names_count_by_whole_words(model, name, around):
    inner = f"<article><div class={name}>{BODY}</div></article>"
    only = f"<div class={name}>{BODY}</div>"
    for x in (inner, only):
        assert extraction.extract(f"<html><body>{around.format(x)}</body></html>", model) == WANT


@pytest.mark.parametrize("around", AROUND)
@pytest.mark.parametrize(
    "layout",
    [
        "{}", "<div>{}</div>", "<div><div><div><div><div><div>{}</div></div></div></div></div></div>", "<main>{}</main>", "<main><section>{}</section></main>",
        "<section>{}</section>", "<article>{}</article>", "<article><header><h1>Headline here</h1></header>{}</article>", "<div id=wrapper><div id=mainCol>{}</div></div>",
    ],
)
def test_layouts_that_are_not_drawn(model, layout, around):
    body = BODY.replace("<h1>Headline here</h1>", "") if "<header>" in layout else BODY
    assert extraction.extract(f"<html><head><title>T</title></head><body>{around.format(layout.format(body))}</body></html>", model) == WANT


def test_bare_text_is_content(model):
    assert extraction.extract(f"{ONE}<br>{TWO}", model) == f"{ONE} {TWO}"
    assert extraction.extract(f"<html><body>{ONE}</body></html>", model) == ONE


def test_quotes_count_after_an_equals_sign_only(model):
    for tag in ("<p title=Bob's>", "<p Bob's>", "<p ' \">", "<p title=a'b\"c>", "<p title = \"a > b\">"):
        page = f"<html><body><article><h1>Headline here</h1>{tag}{ONE}</p><p>{TWO}</p></article><footer>f</footer></body></html>"
        assert extraction.extract(page, model) == WANT, tag


def test_unclosed_tags_take_linear_time(model):
    for make in (lambda n: "<span>" * n + "</b>" * n, lambda n: "<p>" + "<span>" * n + "<h1>" * n, lambda n: "<ul><li>" + "<i>" * n + "<li>" * n, lambda n: "<p a=" * n, lambda n: "<body>" * n, lambda n: '<p a="' * n):
        took = []
        for n in (5_000, 20_000):
            start = time.process_time()
            extraction.extract(make(n), model)
            took.append(time.process_time() - start)
        assert took[1] < 12 * took[0] + 0.5


LONG = {
    "blanks in a key block": "-----BEGIN PRIVATE KEY-----" + " " * 1_000_000,
    "heads of key blocks": "-----BEGIN PRIVATE KEY-----\n" * 40_000,
    "words of a head": "-----BEGIN " + "A " * 500_000,
    "starts of tokens": "eyJ" * 340_000,
    "parts of tokens": "eyJa.eyJ" * 120_000,
    "a name and blanks": "password" + " " * 1_000_000,
    "digits": "0" * 1_000_000,
    "prefixes": "ghp_" * 250_000,
}


@pytest.mark.parametrize("name", LONG)
def test_secrets_of_long_texts(name):
    start = time.process_time()
    found = secrets.spans(LONG[name])
    assert time.process_time() - start < 15
    assert [k for _, _, k in found] == (["hex"] if name == "digits" else [])


def encoded(x):
    import base64

    return base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")


def test_added_kinds_are_found_and_near_misses_are_not():
    body = "aB3" * 10
    npm = f"npm_{body}{secrets.base62_crc(body)}"
    jwt = f"{encoded({'alg': 'HS256'})}.{encoded({'sub': 'x'})}.sig-_1"
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "QUJD" * 20 + "\n" + "QUJD" * 4 + "\n-----END RSA PRIVATE KEY-----"
    text = f"é {npm} then {jwt} and\n{pem}\nend"
    want = sorted((text.index(x), text.index(x) + len(x), k) for x, k in ((npm, "npm"), (jwt, "jwt"), (pem, "pem")))
    assert secrets.spans(text) == want and "[SECRET]" in secrets.masked(text) and "QUJD" not in secrets.masked(text)
    wrong = [npm[:-1] + ("0" if npm[-1] != "0" else "1"), jwt.replace(encoded({"alg": "HS256"}), encoded({"x": 1})), pem.replace("END RSA", "END EC"), pem.replace("QUJD" * 20, "QUJ"), pem.replace("-----\nQ", "-----Q")]
    for x in wrong:
        assert [k for _, _, k in secrets.spans(f"a {x} b") if k in ("npm", "jwt", "pem")] == [], x
    assert [k for _, _, k in secrets.spans(f"{jwt[:30]} {wrong[2]} {pem}")] == ["pem"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_every_given_tokenizer_gives_its_librarys_ids(name):
    encode = tokens.encoder(public_tokenizers.path(name))

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(alphabet=" \n\tabcXYZ0129.!é×«“€中▁<s>|\x00'", max_size=30), max_size=5))
    def check(texts):
        raw = [t.encode() for t in texts]
        want = [x.tolist() for x in encode.whole(raw)]
        assert [x.tolist() for x in encode.encode(raw)] == want
        assert list(encode.encode(raw, want_ids=False)) == [len(x) for x in want]

    check()


def test_top_k_refuses_what_a_long_cannot_hold(spark):
    rows = [(100, [1e300, 0.0]), (1, [1.0, 2.0])]
    with pytest.raises(Exception, match="component times scale"):
        topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()


def test_mixed_documents_keep_columns_of_any_name(spark):
    plain = [(i, f"{WORDS} {i}" if i % 3 else None, "ab"[i % 2]) for i in range(20)] + [(7, "one two", "a")] * 4
    names = ["key_", "copies_", "rows_", "NTH_", "times_", "copy_", "copy__"]
    own = [(*row, *range(n, n + len(names))) for n, row in enumerate(plain)]
    docs = spark.createDataFrame(own, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    out = mixing.mixed_documents(docs)
    rows = [tuple(r) for r in out.collect()]
    assert out.columns == docs.columns and set(rows) <= set(own) and rows
    want = mixing.mixed_documents(docs.select("doc_id", "text", "source")).collect()
    assert sorted((r[:3] for r in rows), key=str) == sorted((tuple(r) for r in want), key=str)
