import base64
import random
import textwrap

import numpy as np
import pytest

from tributary.llm import secrets


def _der(n, seed):
    body = b"\x04\x82" + n.to_bytes(2, "big") + random.Random(seed).randbytes(n)
    return b"\x30\x82" + len(body).to_bytes(2, "big") + body


_S = lambda *x: b"".join(len(p).to_bytes(4, "big") + p for p in x)


def _found(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return [text[x["start"] : x["stop"]] for x in secrets.scan_block(data, np.array([0, len(data)]))[0] if not x["base"] and x["kind"] in ("der", "ssh")]


def test_url_safe_keys_are_whole():
    for seed in range(300):
        key = base64.urlsafe_b64encode(_der(595, seed)).decode()
        assert _found(f"é {key} end") == [key]


@pytest.mark.parametrize("width", [32, 64, 76])
@pytest.mark.parametrize("gap", ["\n", "\r\n", "\n    ", '"\n  "', '" +\n  "'])
@pytest.mark.parametrize("code", [lambda b: base64.b64encode(b).decode(), lambda b: base64.urlsafe_b64encode(b).decode(), lambda b: b.hex()])
def test_wrapped_keys(width, gap, code):
    ssh = _S(b"ssh-ed25519", bytes(range(32)))
    block = b"openssh-key-v1\0" + _S(b"none", b"none", b"") + (1).to_bytes(4, "big") + _S(ssh, bytes(range(136)))
    for value in (_der(595, 1), _der(301, 2), _S(b"ssh-rsa", b"\1\0\1", bytes(range(256))), block):
        key = gap.join(textwrap.wrap(code(value), width, break_on_hyphens=False))
        assert _found(f"é text\n{key}\nThe end of it\n") == [key]
        assert _found(f"key: {key}\n\nend") == [key]
        assert value is block or _found(key[: len(key) // 2]) == []


def test_random_bytes_behind_the_magic_are_no_key():
    magic = b"openssh-key-v1\0"
    ssh = _S(b"ssh-ed25519", bytes(range(32)))
    good = magic + _S(b"none", b"none", b"") + (1).to_bytes(4, "big") + _S(ssh, bytes(range(136)))
    two = magic + _S(b"aes256-ctr", b"bcrypt", b"salt") + (2).to_bytes(4, "big") + _S(ssh, ssh, bytes(range(64)))
    for key in (good, two):
        assert _found(base64.b64encode(key).decode()) and _found(key.hex())
    bad = [magic + random.Random(k).randbytes(60 + k) for k in range(40)]
    bad += [good + b"x", good[:-1], good.replace(b"ssh-ed25519", b"ssh-ed25518"), magic + _S(b"none", b"none", b"") + (0).to_bytes(4, "big") + _S(bytes(136)), good[:-4]]
    for key in bad:
        for text in (base64.b64encode(key).decode(), key.hex(), "\n".join(textwrap.wrap(base64.b64encode(key).decode(), 64))):
            assert _found(text) == []
            assert secrets.confirm(key) is None


@pytest.mark.parametrize("size", [99_000, 200_000])
def test_long_wrapped_blobs_are_whole(size):
    blob = _S(b"ssh-rsa", random.Random(size).randbytes(size), bytes(500))
    key = "\n".join(textwrap.wrap(base64.b64encode(blob).decode(), 64))
    assert _found(f"a\n{key}\nb") == [key]
    key = "\n".join(textwrap.wrap(blob.hex(), 76))
    assert _found(f"a\n{key}\nb") == [key]


def test_heads_on_many_lines_take_little_time():
    import time

    line = base64.b64encode(_S(b"ssh-rsa") + ((1 << 20) + 1).to_bytes(4, "big") + b"\xff" * 30).decode().rstrip("=") + "A" * 8
    began = time.process_time()
    assert _found("\n".join([line] * 140_000)) == []  # 10 MB
    assert time.process_time() - began < 20
