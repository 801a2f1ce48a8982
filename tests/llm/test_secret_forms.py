"""Keys whose encoding spans lines, or mixes cases, are reported and redacted."""

from __future__ import annotations

import base64
import json
import random

import pytest

from skeinlake.llm import secrets


def der(tag, body):
    n = len(body)
    head = bytes([n]) if n < 128 else (lambda w: bytes([0x80 | len(w)]) + w)(n.to_bytes((n.bit_length() + 7) // 8, "big"))
    return bytes([tag]) + head + body


def pkcs8(size=600, seed=5):
    inner = random.Random(seed).randbytes(size)
    return der(0x30, der(0x02, b"\0") + der(0x30, der(0x06, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01") + der(0x05, b"")) + der(0x04, inner))


KEY = pkcs8()
B64 = base64.b64encode(KEY).decode()


def wrap(text, width, sep="\n"):
    return sep.join(text[i : i + width] for i in range(0, len(text), width))


PEM = f"-----BEGIN PRIVATE KEY-----\n{wrap(B64, 64)}\n-----END PRIVATE KEY-----\n"
MIXED = "".join(c.upper() if i % 3 else c for i, c in enumerate(KEY.hex()))
FULL = next(k for k in (pkcs8(n) for n in range(500, 800)) if len(k) % 48 == 0)

FORMS = {
    "json": ("pem", json.dumps({"type": "service_account", "private_key": PEM})),
    "json in json": ("pem", json.dumps(json.dumps({"private_key": PEM}))),
    "json with escaped slashes": ("pem", json.dumps({"private_key": PEM}).replace("/", "\\/")),
    "json, carriage returns": ("pem", json.dumps({"private_key": PEM.replace("\n", "\r\n")})),
    "64 columns": ("der", f"the key:\n{wrap(B64, 64)}\nend of it\n"),
    "76 columns": ("der", f"the key:\n{wrap(B64, 76)}\n\nend"),
    "76 columns, indented, CRLF": ("der", "key: |\r\n  " + wrap(B64, 76, "\r\n  ") + "\r\n"),
    "64 columns in json": ("der", json.dumps({"k": "key:\n" + wrap(B64, 64)})),
    "full last line": ("der", wrap(base64.b64encode(FULL).decode(), 64) + "\nend"),
    "one line behind an escaped break": ("der", '{"k": "key:\\n' + B64 + '"}'),
    "encoded once more, wrapped": ("pem", wrap(base64.b64encode(PEM.encode()).decode(), 76)),
    "mixed-case hex": ("der", f"key {MIXED} end"),
    "wrapped hex": ("der", wrap(KEY.hex(), 64)),
}


@pytest.mark.parametrize("form", FORMS)
def test_form_is_found_and_redacted(form):
    kind, text = FORMS[form]
    assert kind in [k for _, _, k in secrets.added_spans(text)]
    left = secrets.redact_text(text)
    assert not any(p in left for p in (B64[80:120], B64[300:340], KEY.hex()[200:240], MIXED[200:240]))
    assert secrets.redact_text(left) == left


def test_keys_of_full_lines_in_a_row_are_two():
    one, two = (wrap(base64.b64encode(k).decode(), 64) for k in (FULL, pkcs8(len(FULL) - 26, 9)))
    assert [k for _, _, k in secrets.added_spans(f"{one}\n{two}\n")] == ["der", "der"]


def test_what_does_not_parse_is_not_reported():
    rng = random.Random(1)
    noise = base64.b64encode(rng.randbytes(700)).decode()
    for text in (wrap(noise, 64), wrap(B64[:-8], 64), json.dumps(wrap(noise, 76)), MIXED[:-2], PEM.replace(B64[4:8], "AAAA").replace("\n", "\\n")):
        assert not secrets.added_spans(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, ("b" * 60 + "\n") * 5000, "\\n" * 100_000, ("MIIB" + "A" * 60 + "\n") * 300):
        secrets.added_spans(text)
