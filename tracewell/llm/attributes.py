"""Rated attributes of electrical goods, read from free catalogue text in one common form."""

from __future__ import annotations

import re

# Words for one attribute value, by kind.
WORDS = {
    "colour": {
        "black": ["black", "블랙", "흑색"], "white": ["white", "화이트", "백색"], "silver": ["silver", "실버", "은색"], "red": ["red", "적색", "레드"],
        "gray": ["gray", "grey", "회색", "그레이"], "green": ["green", "녹색"], "blue": ["blue", "청색"], "yellow": ["yellow", "황색"],
    },
    "material": {
        "cu": ["cu", "copper", "구리", "동"], "al": ["al", "aluminium", "aluminum", "알루미늄"], "steel": ["steel", "스틸", "강제"],
        "frp": ["frp", "유리섬유", "fibreglass", "fiberglass"], "pvc": ["rigid pvc", "pvc", "경질비닐"], "hdpe": ["hdpe", "hd-pe", "고밀도pe"],
        "sts": ["stainless", "sts", "스테인리스"],
    },
    "temper": {"soft": ["soft", "annealed", "연질"], "hard": ["hard-drawn", "hard", "경질"]},
    "form": {"gel": ["gel", "겔형"], "powder": ["powder", "분말"]},
}
_N = r"(\d+(?:\.\d+)?)"
_B = r"(?<![\w.])"
_NUMBERS = [
    ("size", re.compile(rf"{_B}{_N} ?[x×*] ?{_N} ?(mm|cm|m)\b"), None),
    ("size", re.compile(rf"{_B}w ?{_N} ?h ?{_N}\b"), None),
    ("length_mm", re.compile(rf"(?:\bl ?= ?|길이 ?|\blength ){_N} ?(mm|cm|m)\b"), {"mm": 1, "cm": 10, "m": 1000}),
    ("area_mm2", re.compile(rf"{_B}{_N} ?(?:mm²|mm2|sq)(?![a-z\d])"), None),
    ("pack_kg", re.compile(rf"(?:bag of |pack ){_N} ?kg|{_B}{_N} ?kg ?(?:/ ?포|포장)"), None),
    ("thick_mm", re.compile(rf"{_B}{_N} ?(mm|cm)(?![a-z²\d])"), {"mm": 1, "cm": 10}),
    ("volt", re.compile(rf"{_B}{_N} ?(kv|v)(?![a-z\d])"), {"kv": 1000, "v": 1}),
    ("kva", re.compile(rf"{_B}{_N} ?(mva|kva)(?![a-z\d])"), {"mva": 1000, "kva": 1}),
    ("ka", re.compile(rf"{_B}{_N} ?ka(?![a-z\d])"), None),
    ("amp", re.compile(rf"{_B}{_N} ?(?:amp|at|a)(?![a-z\d])"), None),
    ("watt", re.compile(rf"{_B}{_N} ?(kw|w)(?![a-z\d])"), {"kw": 1000, "w": 1}),
    ("kelvin", re.compile(rf"{_B}{_N} ?k(?![a-z\d])"), None),
    ("poles", re.compile(rf"{_B}{_N} ?-?(?:poles?|p|극)(?![a-z\d])"), None),
    ("cores", re.compile(rf"{_B}{_N} ?-?(?:cores?|c|심)(?![a-z\d])"), None),
    ("cells", re.compile(rf"{_B}{_N} ?-?(?:cells?|셀)(?![a-z\d])"), None),
]
_WORDS = [
    (kind, value, re.compile("|".join(rf"(?<![\w-]){re.escape(w)}(?![\w-])" for w in words))) for kind, values in WORDS.items() for value, words in values.items()
]


def _number(x: float) -> str:
    return f"{x:.6g}"


def read_attributes(text: str) -> dict[str, list[str]]:
    """kind to all values stated, sorted; ``text`` is folded and lower case.

    What a number belongs to (the product, its package, its price) is not decided here.
    """
    seen: dict[str, set[str]] = {}
    for kind, pattern, scale in _NUMBERS:
        taken = False
        for m in pattern.finditer(text):
            g = [x for x in m.groups() if x]
            if kind == "size":
                k = {"mm": 1, "cm": 10, "m": 1000}.get(g[2], 1) if len(g) > 2 else 1
                value = "x".join(_number(float(x) * k) for x in g[:2])
            else:
                value = _number(float(g[0]) * (scale[g[1]] if scale else 1))
            seen.setdefault(kind, set()).add(value)
            taken = True
        if taken:
            text = pattern.sub(" ", text)
    for kind, value, pattern in _WORDS:
        if pattern.search(text):
            seen.setdefault(kind, set()).add(value)
    return {kind: sorted(values) for kind, values in seen.items()}
