"""Layers that hide secrets in wrapped, wider and further compressed payloads, with the places they come from."""

from __future__ import annotations

import base64
import bz2
import gzip
import lzma
import random

import pytest

from verbatia.llm.secrets import find_secrets

SECRET = "password=abcdefgh12345678"


def wrapped(raw: bytes, width: int, end: str) -> str:
    text = base64.b64encode(raw).decode()
    return end.join(text[i : i + width] for i in range(0, len(text), width))


@pytest.mark.parametrize("end", ["\n", "\r\n", "\\n", "\\r\\n", "\n    "])
@pytest.mark.parametrize("width", [56, 60, 64, 76])
@pytest.mark.parametrize("fold", [lambda x: x, gzip.compress, bz2.compress, lzma.compress])
def test_payloads_wrapped_over_lines(fold, width, end):
    r = random.Random(width)
    for ahead in (0, 20, 41, 55, 90):
        filler = " ".join(str(r.getrandbits(60)) for _ in range(20))
        hidden = fold((filler[:ahead] + " " + SECRET + " " + filler).encode())
        text = "Dear all,\n\n" + wrapped(hidden, width, end) + "\n\nBest regards"
        found = [(k, s, e) for k, s, e, d in find_secrets(text) if k == "assign"]
        assert found, (ahead, width)
        begin, stop = text.index(wrapped(hidden, width, end)), len(text) - len("\n\nBest regards")
        assert all(begin <= s < e <= stop for _, s, e in found)
        if fold(b"x") == b"x":
            # The place in the text decodes to the secret.
            _, s, e = found[0]
            body = text[s:e].replace(end, "")
            assert e - s < 4 / 3 * len(SECRET) + 8 + 2 * len(end) and len(body) >= len(SECRET)


def test_joined_lines_are_not_scanned_as_such():
    assert [x[:3] for x in find_secrets("password=abcdefghijklmnop\nnext words")] == [("assign", 0, 25)]
    assert [x[:3] for x in find_secrets("0123456789abcdef0123\nabcdef is hex")] == [("hex", 0, 20)]


def test_wider_characters_and_named_references():
    text = "see " + base64.b64encode(f"x {SECRET} y".encode("utf-16-le")).decode()
    assert ("assign" in {k for k, *_ in find_secrets(text)}) and all(s >= 4 for _, s, *_ in find_secrets(text))
    quoted = "token&quot;: &quot;abcdefgh12345678&quot;"
    assert [(k, s, e) for k, s, e, _ in find_secrets(quoted)] == [("assign", 0, quoted.rindex("&quot;"))]


@pytest.mark.parametrize("fold", [bz2.compress, lzma.compress])
def test_large_and_damaged_members_end(fold):
    big = fold((b"filler " * 3_000_000) + b" token=abcdefgh12345678 ")
    assert ("assign", 0, len(base64.b64encode(big))) in [x[:3] for x in find_secrets(base64.b64encode(big).decode())]
    find_secrets(base64.b64encode(big[: len(big) // 2]).decode())
    find_secrets(base64.b64encode(big[:20] + b"\0" * 40).decode())


@pytest.mark.parametrize("case", [str, str.upper])
@pytest.mark.parametrize("fold", [lambda x: x, gzip.compress, bz2.compress])
def test_hexadecimal_layers(fold, case):
    digits = case(fold(f"see {SECRET} here".encode()).hex())
    for ahead, behind in (("", ""), ("dump: ", "."), ("x", "z")):
        text = f"{ahead}{digits}{behind}"
        found = [(s, e) for k, s, e, d in find_secrets(text) if k == "assign" and d]
        assert found and all(len(ahead) <= s < e <= len(ahead) + len(digits) for s, e in found)
        if fold(b"x") == b"x":
            assert bytes.fromhex(text[slice(*found[0])]).decode() == SECRET


def test_hexadecimal_layers_with_a_stray_digit_or_wrapped_over_lines():
    digits = f"see {SECRET} here".encode().hex()
    for text in ("a" + digits, digits + "a", digits[:40] + "\n" + digits[40:], base64.b64encode(digits.encode()).decode()):
        assert "assign" in {k for k, *_ in find_secrets(text)}, text
