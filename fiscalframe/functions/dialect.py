"""Rules are written in Python's regex syntax; Spark matches with Java's.

``to_java`` rewrites one rule so that Java finds the same first match that
Python finds with IGNORECASE, MULTILINE and DOTALL on text.  Only spelling
changes: the shorthand classes get Python's members, and constructs that Java
spells differently are respelled.
"""

from __future__ import annotations

import re
import unicodedata

# i = ignore case, m = multiline, s = dot matches all, d = only "\n" ends a
# line, u = Unicode case folding.
JAVA_FLAGS = "(?imsdu)"

# Members of Python's \s, \w and \d for str patterns, as Java class bodies.  The
# spaces outside ASCII are one category but for U+0085; listed one by one they
# would each cost a test per character.
SPACE = r"\t\n\x0B\f\r\x1c\x1d\x1e\x1f\x20\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"

_OUTSIDE = {
    "s": f"[{SPACE}]",
    "S": f"[^{SPACE}]",
    "w": f"[{WORD}]",
    "W": f"[^{WORD}]",
    "d": DIGIT,
    "D": r"\P{Nd}",
    "b": f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))",
    "B": f"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))",
    "Z": r"\z",
    "v": r"\x0B",
}
_INSIDE = {
    "s": SPACE,
    "S": f"[^{SPACE}]",
    "w": WORD,
    "W": f"[^{WORD}]",
    "d": DIGIT,
    "D": r"\P{Nd}",
    "b": r"\x08",
    "v": r"\x0B",
}
_TOKEN = re.compile(
    r"""
      \\U(?P<astral>[0-9a-fA-F]{8})
    | \\N\{(?P<character>[^}]*)\}
    | \\0(?P<octal>[0-7]{0,2})
    | \\(?P<escape>.)
    | \(\?P<(?P<named>\w+)>
    | \(\?P=(?P<backref>\w+)\)
    | (?P<comment>\(\?\#[^)]*\))
    | (?P<conditional>\(\?\()
    | \(\?(?P<flags>[aiLmsux]+)(?P<flag_end>[):])
    | (?P<negated>\[\^)
    | \{(?P<low>\d*)(?P<high>,\d*)?\}
    | (?P<plain>.)
    """,
    re.VERBOSE | re.DOTALL,
)


def to_java(pattern: str) -> str:
    """Java spelling of a Python pattern, with the flags every rule runs under.

    Raises ValueError for the few constructs Java has no equivalent of.
    """
    names: dict[str, str] = {}
    out: list[str] = []
    in_class = first_in_class = top_level_choice = False
    depth = 0

    for token in _TOKEN.finditer(pattern):
        text = token.group()
        just_opened, first_in_class = first_in_class, False
        if token["astral"]:
            out.append(r"\x{%s}" % token["astral"].lstrip("0"))
        elif token["character"]:
            out.append(r"\x{%x}" % ord(unicodedata.lookup(token["character"])))
        elif token["octal"] is not None:
            out.append(r"\x%02x" % int(token["octal"] or "0", 8))
        elif token["escape"]:
            out.append((_INSIDE if in_class else _OUTSIDE).get(token["escape"], text))
        elif in_class:
            # "[" and "&" mean something in a Java class and nothing in Python's.
            if text == "]" and not just_opened:
                in_class = False
                out.append("]")
            else:
                out.append("".join("\\" + c if c in "[]&^" else c for c in text))
        elif text == "[" or token["negated"]:
            in_class = first_in_class = True
            out.append(text)
        elif token["named"]:
            depth += 1
            names[token["named"]] = f"g{len(names)}"
            out.append(f"(?<{names[token['named']]}>")
        elif token["backref"]:
            out.append(rf"\k<{names[token['backref']]}>")
        elif token["comment"]:
            pass
        elif token["conditional"]:
            raise ValueError("i gruppi condizionali (?(...)...) non sono supportati")
        elif token["flags"]:
            if set(token["flags"]) & set("aLx"):
                raise ValueError(f"opzione non supportata: {text}")
            depth += token["flag_end"] == ":"
            kept = token["flags"].replace("u", "")
            out.append("" if not kept and token["flag_end"] == ")" else f"(?{kept}{token['flag_end']}")
        elif text.startswith("{") and text != "{}" and len(text) > 1:
            out.append("{%s%s}" % (token["low"] or "0", token["high"] or ""))
        elif text[0] == "{":
            out.append(text.replace("{", r"\{").replace("}", r"\}"))
        else:
            depth += (text == "(") - (text == ")")
            top_level_choice |= text == "|" and depth == 0
            out.append(text)

    java = "".join(out)
    if java.startswith("^(.+?") and not top_level_choice:
        # "." crosses lines here, so a match from a later line start implies one
        # from the start of the text, which is found first: anchoring there is
        # equal and saves a scan of the rest of the text per line.
        java = r"\A" + java[1:]
    return JAVA_FLAGS + java
