"""Calls by bracket depth, against the language's own parser and on shapes that hurt patterns."""

import ast
import random
import time

import pytest

from cipherledger.functions.python_calls import Source, find_calls
from cipherledger.operators import callsites

LEAVES, KEYWORDS, METHODS, MODES = set(callsites.LEAVES), set(callsites.ARGUMENTS), set(callsites.ROLE_OF_METHOD), set(callsites.MODES)


def calls(text):
    return find_calls(text, LEAVES, KEYWORDS, METHODS, MODES)


def detected(spark, text):
    return {(r.line, r.algorithm, r.key_size, r.role, r.mode, r.curve) for r in callsites.call_detections(spark.createDataFrame([("a.py", text)], "path string, text string")).collect()}


def dotted(node):
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        return ".".join([node.id, *reversed(parts)])
    if isinstance(node, ast.Call) and dotted(node.func):
        return ".".join([dotted(node.func), *reversed(parts)])
    return None


def parsed(text):
    """(callee, line, positional arguments, keywords, assigned name) of every call."""
    tree = ast.parse(text)
    parent = {id(c): p for p in ast.walk(tree) for c in ast.iter_child_nodes(p)}
    out = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Call) and dotted(n.func):
            p = parent.get(id(n))
            while isinstance(p, ast.Call):
                p = parent.get(id(p))
            one = isinstance(p, ast.Assign) and len(p.targets) == 1 and isinstance(p.targets[0], ast.Name)
            target = p.targets[0].id if one else p.target.id if isinstance(p, ast.AnnAssign) and isinstance(p.target, ast.Name) else None
            out.append((dotted(n.func), n.lineno, len(n.args), tuple(sorted(k.arg for k in n.keywords if k.arg)), target))
    return sorted(out, key=str)


def scanned(text):
    s = Source(text)
    out = []
    for k, c in enumerate(s.calls):
        names = [n for n, *_ in s.arguments(c)]
        out.append((c.callee, c.line, sum(n.isdigit() for n in names), tuple(sorted(n for n in names if not n.isdigit())), s.assigned(k)))
    return sorted(out, key=str)


def expression(rng, depth):
    """A random expression, often over several lines."""
    kind = rng.randrange(9) if depth else rng.randrange(3)
    sub = lambda: expression(rng, depth - 1)
    gap = rng.choice(["", "", " ", "\n  ", "  # (note\n "])
    if kind == 0:
        return rng.choice(["a", "b.c", "x1", "k"])
    if kind == 1:
        return rng.choice(["1", "0x1F", "'t(ext'", '"a)b"', "b'x'", '"""long\n(string"""', "'it\\'s('"])
    if kind == 2:
        return rng.choice(["hashlib.md5(d)", "os.urandom(32)", "f()"])
    if kind == 3:
        return f"{rng.choice(['f', 'mod.g', 'a.b.h'])}({gap}{sub()}, {gap}key={sub()}{rng.choice(['', ','])}{gap})"
    if kind == 4:
        return f"g({gap}{sub()}{gap},{gap}{sub()})"
    if kind == 5:
        return f"({gap}{sub()}{gap})"
    if kind == 6:
        return f"[{sub()}, {sub()}]"
    if kind == 7:
        return f"mod.C({sub()}).m({sub()})"
    return f"({sub()},{gap} {sub()})"


def test_random_sources_agree_with_the_parser():
    rng = random.Random(11)
    for _ in range(1500):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            e = expression(rng, rng.randrange(4))
            lines.append(rng.choice([f"x = {e}", f"y: int = {e}", e, f"a = b = {e}", f"if f(1): z = {e}", f"def fun(p=1):\n    return {e}", f"w.attr = {e}",
                                     f"x = 1; v = {e}", f"class K(Base):\n    q = {e}", f"u = \\\n  {e}", f"n += {e}"]))
        text = "\n".join(lines) + rng.choice(["", "\n"])
        assert scanned(text) == parsed(text), text


def test_wide_and_deep_brackets(spark):
    wide = "import hashlib\nx = f(" + ", ".join(["(1,2)"] * 30_000) + ")\nh = hashlib.md5(x)\n"
    deep = "import hashlib\n" + "h = " + "(" * 50_000 + "hashlib.md5(d)" + ")" * 50_000 + "\n" + "g(" * 20_000 + "hashlib.sha1(d)" + ")" * 20_000
    start = time.time()
    assert [(c["canon"], c["line"]) for c in calls(wide)] == [("hashlib.md5", 3)]
    assert [(c["canon"], c["line"]) for c in calls(deep)] == [("hashlib.md5", 2), ("hashlib.sha1", 3)]
    assert [c["line"] for c in calls("import hashlib\nx = f(" + "\n".join(["hashlib.md5(a),"] * 20_000) + ")")] == list(range(2, 20_002))
    assert [c["line"] for c in calls("import hashlib\n" + "hashlib.md5(" * 2_000)] == [2] * 2_000
    assert time.time() - start < 30
    assert {r[:2] for r in detected(spark, wide)} == {(3, "md5")}


def test_each_call_keeps_its_own_line(spark):
    text = "import hashlib\nx = (\n" + "".join(f"  hashlib.md5(a{k}),\n" for k in range(10)) + ")\n"
    assert {r[:2] for r in detected(spark, text)} == {(k + 3, "md5") for k in range(10)}


def test_backslashes_join_lines(spark):
    text = "from cryptography.hazmat.primitives.asymmetric import \\\n    rsa\nkey = \\\n  rsa.generate_private_key(65537, key_size=1024 * \\\n 2)\nkey.decrypt(c)\n"
    assert detected(spark, text) == {(4, "rsa", 2048, "decryption", None, None)}


def test_arguments_roles_and_modes(spark):
    text = """import os, ssl
from cryptography.hazmat.primitives.ciphers import Cipher, algorithms, modes
from cryptography.hazmat.primitives.asymmetric import ec as curves, rsa
from Crypto.Cipher import AES
import jwt, hmac, hashlib
SIZE = 4096
BYTES = 32
k = os.urandom(BYTES)
c = Cipher(algorithms.AES(k), modes.GCM(iv))
d = AES.new(os.urandom(16), AES.MODE_CBC, iv=b"modes.GCM(")
own = curves.generate_private_key(curves.SECP384R1())
signer = wrap(rsa.generate_private_key(public_exponent=3, key_size=SIZE))
signer.sign(m)
other = {"k": rsa.generate_private_key(3, key_size=1 << 11)}
token = jwt.encode(p, s, algorithm="ES256")
seen = jwt.decode(t, s, algorithms=["none", "HS256"])
mac = hmac.new(key, msg, digestmod=hashlib.sha1)
"""
    got = detected(spark, text)
    assert {r for r in got if r[0] < 15} == {
        (9, "aes-256", 256, "encryption", "gcm", None), (10, "aes-128", 128, "encryption", "cbc", None),
        (11, "ecdsa", None, "digital-signature", None, "secp384r1"), (12, "rsa", 4096, "digital-signature", None, None), (14, "rsa", 2048, "unknown", None, None)}
    assert {r[:2] for r in got if r[0] >= 15} == {(15, "ecdsa"), (16, "hmac-sha256"), (17, "hmac-sha1")}


@pytest.mark.parametrize("text", ["", "x = (", ")]}", "import", "from", "from . import a", "'''open", '"open', "x = 1 << 99999999999",
                                  "hashlib.md5(", "\\", "a.\n(b)", "é = hashlib.md5(1)", "x = rsa.generate(" + "9" * 5000 + ")"])
def test_broken_files_are_no_error(text):
    calls(text)
