import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import secrets as X
from tessera.llm.common import text_bytes

from .common import awkward, empty

HEX = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"


def test_models_part_labelled_samples():
    judge = X.Judge(X.labelled_samples())
    scores = [(judge.score(s), y) for s, y in X.labelled_samples(500, seed=123)]
    right = sum((s >= X.MARGIN) == bool(y) for s, y in scores)
    assert right >= 0.99 * len(scores)


PIECES = ["password", "Api_Key", "TOKEN", '"', "'", " ", ": ", "= ", "=", "secretvalue123", "short", "AKIA", "ABCDEFGH1234", HEX, HEX.upper(), "aZ3kQ9xW2mL8vB5nT7", "the_config_value_2024", "é", "\n", "ſecret", "."]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=9).map("".join))
def test_base_like_plain_patterns(text):
    import pyarrow as pa

    want = []
    at = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    want += [(m.start(), m.end(), "assign") for m in at.finditer(text) if len(m[2]) >= 8]
    want += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    want += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    assert X.base_spans(text) == X.ordered(want)
    judge = X.Judge(X.labelled_samples(300))
    some = bool(want or X.random_spans(text, X.base_spans(text), judge, X.MARGIN))
    assert X.may_hold(*text_bytes(pa.array([text])))[0] or not some


def test_necessary_condition_over_rows():
    import pyarrow as pa

    rows = ["a" * 20, "b" * 8, None, "1" * 9, "AKIAABCDEFGHIJKL", "", "x=1"]
    assert X.may_hold(*text_bytes(pa.array(rows)))[[4, 6]].all()
    assert not X.may_hold(np.zeros(0, np.uint8), np.zeros(1, np.int64)).any()


def test_table(spark):
    text = f'é token = "{HEX}" and aZ3kQ9xW2mL8vB5nT7 here'
    docs, rows = awkward(spark)
    docs = docs.unionByName(spark.createDataFrame([(77, text)], "doc_id long, text string"), allowMissingColumns=True)
    got = {(r.doc_id, r.n_assign, r.n_hex): r for r in X.secret_digest(docs).collect()}
    r = got[77, 1, 1]
    base = [f"assign:2:{11 + 40}", f"hex:11:{11 + 40}"]
    assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
    assert r.spans == ",".join([*base, "random:57:75"]) and r.n_random == 1
    assert got[1000, 0, 0].spans == "" and X.secret_digest(docs).count() == len(rows) + 1
    clean = X.scan_secrets(docs, keep=docs.columns, redact="[S]", out="_spans").where("doc_id = 77").first()
    assert clean.text == 'é [S]" and [S] here'
    assert X.secret_digest(empty(spark)).count() == 0


def test_keys_beside_ordinary_characters():
    import random

    judge, r = X.Judge(X.labelled_samples()), random.Random(3)
    letters, plain = X.ALPHABET[:52], X.ALPHABET[:62]
    cases = [("service_account_access_key=", 24, plain), ("com/services/project/config/access/", 24, plain), ("STRIPE_LIVE_KEY=", 24, plain)]
    cases += [("client_credentials=", 32, plain), ("AWS_SECRET_ACCESS_KEY=", 40, plain), ("", 24, letters)]
    for before, n, alphabet in cases:
        whole = 0
        for _ in range(200):
            text = f"see {before}{''.join(r.choices(alphabet, k=n))}, then"
            spans = X.random_spans(text, X.base_spans(text), judge, X.MARGIN)
            whole += any(a <= 4 + len(before) and b == len(text) - 6 for a, b, _ in spans)
        assert whole >= 190, before
    for _ in range(200):
        text = "AKIA" + "".join(r.choices(X.ALPHABET[:26], k=14)) + "q" + "".join(r.choices(plain, k=30))
        base = X.base_spans(text)
        assert len(X.replaced(text, X.ordered([*base, *X.random_spans(text, base, judge, X.MARGIN)]), "")) == 0
    names = [s for s, y in X.labelled_samples(2000, seed=11) if not y] + ["das_Einheitsverarbeitung", "internationalization", "https/example/documents/library"]
    assert sum(bool(X.random_spans(s, [], judge, X.MARGIN)) for s in names) <= len(names) // 200


# Identifiers and words as they occur in texts and programs; none was made by the rule that makes the samples.
ORDINARY = """getElementsByTagNameNS internationalization application/vnd.ms-excel X-Forwarded-For-Original com/example/project/service/impl/AbstractBeanFactory
/usr/local/share/ca-certificates test_should_return_404_when_missing 2024-01-01T00-00-00 HTTP_X_REQUESTED_WITH org/apache/commons/lang3/StringUtils
node_modules/dist/production-build antidisestablishmentarianism Donaudampfschifffahrtsgesellschaft Rindfleischetikettierungsueberwachungs
ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789abcdef aaaaaaaaaaaaaaaaaaaaaaaa =================a xxxxxxxxxxxxxxxxxxxx
MAX_RETRY_COUNT_PER_HOST_V2 x86_64-unknown-linux-gnu python3-site-packages/numpy/core src/main/java/com/acme/HttpClientV2Impl pneumonoultramicroscopicsilicovolcanoconiosis
customer-support-ticket-2023-10-12 invoice_2024_000123_final release-candidate-12-build-4821 img_20230405_123456_HDR user/profile/settings/privacy
SELECT_FROM_WHERE_GROUP_BY backward-compatibility-layer sha256WithRSAEncryption TLS_AES_256_GCM_SHA384 UTF-8-encoded-string-value StringBufferInputStreamReader
btn-primary-outline-lg-disabled col-md-offset-3-col-sm-12 https//www-example-com/articles/2021/05/11/how-to-write-good-code Geschwindigkeitsbegrenzung anticonstitutionnellement""".split()


def test_recall_and_precision_by_kind():
    import random
    import string
    import uuid

    judge, r = X.Judge(X.labelled_samples()), random.Random(99)
    of = lambda alphabet, k: lambda: "".join(r.choices(alphabet, k=k))
    kinds = {
        "letters": of(string.ascii_letters, 24), "small letters": of(string.ascii_lowercase, 24), "capitals": of(string.ascii_uppercase, 32), "uuid": lambda: str(uuid.UUID(int=r.getrandbits(128))),
        "base 62": of(string.ascii_letters + string.digits, 20), "base 64": of(string.ascii_letters + string.digits + "+/", 40), "base 36": of(string.ascii_lowercase + string.digits, 16), "short hex": of("0123456789abcdef", 20),
    }
    for name, make in kinds.items():
        texts = [f"some text before {make()} and after" for _ in range(300)]
        found = [bool(X.random_spans(t, X.base_spans(t), judge, X.MARGIN)) for t in texts]
        assert sum(found) >= 285, name
    wrong = [w for w in ORDINARY if X.random_spans(f"the {w} is", [], judge, X.MARGIN)]
    assert len(wrong) <= 1, wrong


def test_long_texts_take_time_in_proportion():
    import random
    import time

    judge, r = X.Judge(X.labelled_samples()), random.Random(5)
    parts = [f'key {"".join(r.choices(X.ALPHABET[:62], k=24))} token="{"".join(r.choices(X.ALPHABET[:62], k=24))}" /path/to/some/file_{i}' for i in range(4000)]
    one_token = "/".join(f"configuration/settings/{''.join(r.choices(X.ALPHABET[:62], k=24))}/ordinary/path/of/names/and/more" for _ in range(4000))
    unbroken = "".join("configurationsettingsordinarypathofnamesandmore" + "".join(r.choices(X.ALPHABET[:62], k=24)) for _ in range(120_000))
    for text, least in (("\n".join(parts) * 24, 24 * 8000), (one_token * 24, 24 * 3900), (unbroken, 1)):
        began = time.perf_counter()
        base = X.base_spans(text)
        assert len(text) > 7_000_000 and len(base) + len(X.random_spans(text, base, judge, X.MARGIN)) >= least
        assert time.perf_counter() - began < 60


#: Ordinary words of several languages, none of them among the samples.
FOREIGN = (
    "Geschwindigkeitsbegrenzung Donaudampfschifffahrtsgesellschaft Staatsangehoerigkeit anticonstitutionnellement electroencefalografista hottentottententententoonstelling "
    "nieprawdopodobienstwo Przedsiebiorstwo-Produkcyjno przeciwdzialanie-bezrobociu srpskohrvatski-bosanski tietokoneohjelma lentokonesuihkuturbiinimoottori desenvolvimento-sustentavel "
    "responsabilidades internationalization linux-gnu/libstdc++ kubernetes-dashboard megszentsegtelenithetetlensegeskedeseitekert samochodowy_kierowca"
).split()


def test_precision_with_words_of_labelled_texts(spark):
    """What the corpus' own good texts look like isn't random, nor are ordinary words of other languages; random strings are."""
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("needs the driver's tables")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    words = X.ordinary_words(docs, labels)
    assert 500 < len(words) <= X.FROM_TEXTS and words == X.ordinary_words(docs, labels)
    judge = X.Judge(X.labelled_samples() + words)
    added = [t[a:b] for t in (r.text or "" for r in docs.select("text").collect()) for a, b, _ in X.random_spans(t, X.base_spans(t), judge, X.MARGIN)]
    assert added == []
    assert sum(bool(X.random_spans(w, [], judge, X.MARGIN)) for w in FOREIGN) <= 1
    r = random.Random(8)
    for alphabet, n in ((X.ALPHABET[26:52], 24), (X.ALPHABET[:26], 32), (X.ALPHABET[:62], 20), (X.ALPHABET[26:62], 16), (X.ALPHABET[:64], 40)):
        found = sum(bool(X.random_spans("".join(r.choices(alphabet, k=n)), [], judge, X.MARGIN)) for _ in range(300))
        assert found >= 0.95 * 300
    assert X.ordinary_words(docs, labels.where("false")) == [] and X.ordinary_words(docs.where("false"), labels) == []


def test_stretches_like_brute_force():
    """The best stretch by its definition: of all stretches long enough the greatest sum above the margin, if its evidence reaches."""
    judge = X.Judge(X.labelled_samples())
    r = random.Random(12)
    seen = 0
    for _ in range(150):
        parts = [r.choice(X.WORDS) if r.random() < 0.6 else "".join(r.choices(X.ALPHABET[:62], k=r.randint(8, 26))) for _ in range(r.randint(1, 5))]
        text = "".join(parts)
        if len(text) < X.SHORTEST:
            continue
        steps = judge.steps(X._codes(text))
        total = np.concatenate([[0.0], np.cumsum(steps)])
        every = [(float(total[b - 1] - total[a]) - X.MARGIN * (b - 1 - a), a, b) for a in range(len(text)) for b in range(a + X.SHORTEST, len(text) + 1)]
        best = max(every)
        got = X.stretches(text, 0, len(text), steps, X.MARGIN)
        reaches = total[best[2] - 1] - total[best[1]] >= X.EVIDENCE
        if reaches and any(c.isalpha() for c in text[best[1] : best[2]]):
            seen += 1
            assert any(a <= best[1] and best[2] <= b for a, b in got)
        for a, b in got:
            assert b - a >= X.SHORTEST
    assert seen > 20
