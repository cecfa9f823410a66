import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from keysieve.llm import pii

GRAMMARS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    spans = [(k, m.start(), m.end()) for k, g in GRAMMARS.items() for m in g.finditer(text or "") if valid(k, m.group())]
    return sorted(spans, key=lambda s: (s[1], pii.BASE_KINDS.index(s[0])))


def base(text):
    return [s for s in pii.find(text) if s[0] in pii.BASE_KINDS]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="aZ0159@@..-+ ()%_\né4🙂", max_size=60))
def test_grammars(text):
    assert base(text) == brute(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111-1111-1111-1111", "1.2.3.4", "256.1.1.1", ".5", " ", "+1 (555) 010-9999", "a@b.co",
                                 "x.y@z-1.example.com", "@", "+", "7", "-", "tel:", "https://a.b/c?d=1.2.3.4", "IBAN "]), max_size=10))
def test_grammars_on_pieces(parts):
    assert base("".join(parts)) == brute("".join(parts))


def test_added_kinds():
    text = "see https://example.org/a_(b), mailto:x@y.org; IBAN DE89 3704 0044 0532 0130 00. Account no: 12345678, the acct is closed"
    added = [(k, text[a:b]) for k, a, b in pii.find(text) if k not in pii.BASE_KINDS]
    assert added == [
        ("uri", "https://example.org/a_(b"), ("uri", "mailto:x@y.org"), ("account", "DE89 3704 0044 0532 0130 00"), ("account", "12345678"),
    ]
    assert pii.mask("mail a@b.co or 1.2.3.4!") == "mail <email> or <ip>!"
    assert pii.mask(None) is None


def test_frame(docs):
    rows = [(1, "é🙂 a@b.co 1.2.3.4"), (1, "é🙂 a@b.co 1.2.3.4"), (2, None), (3, ""), (None, "+49 30 1234567"), (4, "1" * 100000 + " x@y.zz " * 5000)]
    got = pii.digests(pii.scan(docs(rows, extra=True))).collect()
    want = []
    for i, t in rows:
        spans = brute(t)
        count = [sum(s[0] == k for s in spans) for k in pii.BASE_KINDS]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((str(i), *count, hashlib.sha256(listed.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted(want)
    assert next(r.spans for r in got if r.doc_id == 1) == "email:3:9,ip:10:17"
    assert pii.scan(docs([])).collect() == []
    assert pii.redact(docs([(1, "a@b.co")])).first().text == "<email>"
