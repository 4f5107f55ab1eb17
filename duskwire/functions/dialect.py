"""Regular expressions of the catalog are RE2; Spark runs Java's. This rewrites what differs, and finds needed literals."""

from __future__ import annotations

import re
import warnings

SPACE = r"\t\n\f\r "
#: RE2's ``\b`` knows ASCII words only.
EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
NOT_EDGE = r"(?:(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<![0-9A-Za-z_])(?![0-9A-Za-z_]))"


def to_java(regex: str, check: bool = False) -> str:
    """The same expression in Java's dialect.

    ``\\b`` and ``\\s`` become ASCII, ``.`` stops at a line feed only, and a ``[`` or
    ``&&`` inside a class is literal. Case folding under ``(?i)`` is ASCII, a known
    difference for two letters (the Kelvin sign and the long s). With ``check`` the
    result is for Python's parser, which lacks one of Java's flags and its nested classes.
    """
    out, i, inside = [], 0, False
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            if i + 1 == len(regex):
                raise ValueError("a backslash ends the expression")
            e = regex[i + 1]
            i += 2
            if e == "s":
                out.append(SPACE if inside else f"[{SPACE}]")
            elif e == "S":
                out.append((f"[^{SPACE}]" if not check else r"\S") if inside else f"[^{SPACE}]")
            elif e == "b" and not inside:
                out.append(EDGE)
            elif e == "B" and not inside:
                out.append(NOT_EDGE)
            elif e in "123456789" and not inside:
                raise ValueError("RE2 has no back-references")
            else:
                out.append(c + e)
            continue
        if inside:
            if c == "]":
                inside = False
            elif c == "[":
                c = r"\["
            elif c == "&" and regex[i + 1 : i + 2] == "&":
                c = r"\&"
            out.append(c)
        elif c == "[":
            inside = True
            m = re.match(r"\[\^?\]?", regex[i:])
            out.append(m[0].replace("]", r"\]"))
            i += len(m[0])
            continue
        elif regex.startswith(("(?=", "(?!", "(?<=", "(?<!"), i):
            raise ValueError("RE2 has no look-around")
        else:
            out.append(c)
        i += 1
    if inside:
        raise ValueError("a class isn't closed")
    body = "".join(out)
    flags = re.match(r"\(\?([is]+)\)", body)
    if check:
        return body
    return f"(?d{flags[1]}){body[flags.end():]}" if flags else f"(?d){body}"


def groups(regex: str) -> int:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return re.compile(to_java(regex, check=True)).groups


def required_literals(regex: str, least: int = 3) -> set[str] | None:
    """Lower-case strings of which every match holds at least one, or None if none of ``least`` characters or more are sure."""
    from re import _constants as k
    from re import _parser

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = _parser.parse(to_java(regex, check=True))

    def better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
        if a is None or b is None:
            return a if b is None else b
        return max(a, b, key=lambda s: (min(map(len, s)), -len(s)))

    def of(seq) -> set[str] | None:
        best, run = None, ""

        def close():
            nonlocal best, run
            if len(run) >= least:
                best = better(best, {run.lower()})
            run = ""

        for op, arg in seq:
            if op is k.LITERAL and arg < 128:
                run += chr(arg)
                continue
            close()
            if op is k.SUBPATTERN:
                best = better(best, of(arg[3]))
            elif op is k.BRANCH:
                each = [of(x) for x in arg[1]]
                if all(each):
                    best = better(best, set().union(*each))
            elif op in (k.MAX_REPEAT, k.MIN_REPEAT) and arg[0] > 0:
                best = better(best, of(arg[2]))
        close()
        return best

    return of(tree)
