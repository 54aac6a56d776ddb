"""Strings, pixels, colours and functions of one value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitized(text: Column) -> Column:
    """Without U+FFFD and what cannot be printed, trimmed; the ASCII space is the one space that stays."""
    return F.trim(F.regexp_replace(text, r"[\p{C}\p{Z}�&&[^ ]]", ""))


#: The ligature code points and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def without_ligatures(text: Column) -> Column:
    for one, many in LIGATURES.items():
        text = F.replace(text, F.lit(one), F.lit(many))
    return text


def has_scheme(uri: Column) -> Column:
    return uri.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:")


def unpremultiplied(colour: Column, alpha: Column) -> Column:
    """Whole-number division with rounding; opaque and clear pixels are unchanged."""
    safe = F.greatest(alpha, F.lit(1))
    return F.when(alpha.isin(0, 255), colour).otherwise(F.least(F.lit(255), F.floor((colour * 255 + F.floor(safe / 2)) / safe))).cast("long")


def colour_byte(value: Column) -> Column:
    """0..1 as a byte, in single precision and truncated; not a number is 0."""
    v = value.cast("float")
    return F.when(F.isnan(v), F.lit(0)).otherwise((F.least(F.greatest(v, F.lit(0.0).cast("float")), F.lit(1.0).cast("float")) * F.lit(255.0).cast("float")).cast("int")).cast("long")


def exponential(x: Column, c0: float, c1: float, power: float) -> Column:
    return F.lit(c0) + F.pow(x, F.lit(power)) * (c1 - c0)


def stitched(x: Column, bounds: list[float], parts: list) -> Column:
    """parts[k] of x where bounds[k - 1] <= x < bounds[k]."""
    out = parts[-1](x)
    for bound, part in reversed(list(zip(bounds, parts, strict=False))):
        out = F.when(x < bound, part(x)).otherwise(out)
    return out


def bilinear(x: Column, y: Column, table: list[list[float]]) -> Column:
    """Samples over the unit square, the first input along a row."""
    rows, columns = len(table), len(table[0])
    u, v = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * (columns - 1), F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0)) * (rows - 1)
    i, j = F.least(F.floor(u), F.lit(columns - 2)), F.least(F.floor(v), F.lit(rows - 2))
    flat = F.array(*[F.lit(float(s)) for row in table for s in row])
    at = lambda di, dj: F.element_at(flat, ((j + dj) * columns + i + di + 1).cast("int"))
    a, b = u - i, v - j
    return at(0, 0) * (1 - a) * (1 - b) + at(1, 0) * a * (1 - b) + at(0, 1) * (1 - a) * b + at(1, 1) * a * b


def _whole(a: Column, b: Column, rule) -> Column:
    """A rule of two numbers cut to whole ones; null where the second is 0."""
    m, n = (F.signum(v) * F.floor(F.abs(v)) for v in (a, b))
    return rule(m, F.nullif(n, F.lit(0.0))).cast("double")


def _low(a: Column) -> Column:
    """The lowest 32 bits as a signed number."""
    return (F.pmod(a + 2147483648.0, F.lit(4294967296.0)) - 2147483648.0).cast("double")


def calculator(program: str, *inputs: Column) -> list[Column]:
    """A stack program as columns: stack operators act while the expression is built, arithmetic when it runs.

    Operators: add sub mul div idiv mod neg abs sqrt ceiling floor round truncate cvi cvr sin cos atan exp ln log bitshift dup
    exch pop copy index roll eq ne gt ge lt le and or xor not true false, numbers, and { } { } ifelse, { } if.  and, or, xor and
    not take truth values here; a whole division by 0 is null.
    """
    stack: list = list(inputs)
    words = program.replace("{", " { ").replace("}", " } ").split()
    two = {
        "add": lambda a, b: a + b,
        "sub": lambda a, b: a - b,
        "mul": lambda a, b: a * b,
        "div": lambda a, b: F.when(b == 0, F.when(a == 0, F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))).otherwise(a / F.nullif(b, F.lit(0.0))),
        "exp": lambda a, b: F.pow(a, b),
        "atan": lambda a, b: F.pmod(F.degrees(F.atan2(a, b)) + 360, F.lit(360.0)),
        "eq": lambda a, b: a == b,
        "ne": lambda a, b: a != b,
        "gt": lambda a, b: a > b,
        "ge": lambda a, b: a >= b,
        "lt": lambda a, b: a < b,
        "le": lambda a, b: a <= b,
        "idiv": lambda a, b: _whole(a, b, lambda m, n: F.signum(m * n) * F.floor(F.abs(m) / F.abs(n))),
        "mod": lambda a, b: _whole(a, b, lambda m, n: F.signum(m) * (F.abs(m) - F.floor(F.abs(m) / F.abs(n)) * F.abs(n))),
        "xor": lambda a, b: a != b,
        "bitshift": lambda a, b: F.when(F.abs(b) >= 32, F.lit(0.0)).when(b >= 0, _low(a * F.pow(F.lit(2.0), b))).otherwise(F.floor(F.pmod(a, F.lit(4294967296.0)) / F.pow(F.lit(2.0), -b)).cast("double")),
        "and": lambda a, b: a & b,
        "or": lambda a, b: a | b,
    }
    one = {
        "neg": lambda a: -a,
        "abs": F.abs,
        "sqrt": F.sqrt,
        "ceiling": lambda a: F.ceil(a).cast("double"),
        "floor": lambda a: F.floor(a).cast("double"),
        "round": lambda a: (F.signum(a) * F.floor(F.abs(a) + 0.5)).cast("double"),
        "cvi": lambda a: F.when(F.isnan(a), F.lit(0.0)).otherwise(F.greatest(F.least(F.signum(a) * F.floor(F.abs(a)), F.lit(2147483647.0)), F.lit(-2147483648.0))),
        "cvr": lambda a: a.cast("double"),
        "truncate": lambda a: (F.signum(a) * F.floor(F.abs(a))).cast("double"),
        "sin": lambda a: F.sin(F.radians(a)),
        "cos": lambda a: F.cos(F.radians(a)),
        "ln": F.log,
        "log": F.log10,
        "not": lambda a: ~a,
    }

    def block(at: int) -> int:
        depth = 0
        for k in range(at, len(words)):
            depth += (words[k] == "{") - (words[k] == "}")
            if not depth:
                return k
        raise ValueError("a block does not end")

    def run(lo: int, hi: int, stack: list) -> list:
        k, blocks = lo, []
        while k < hi:
            word = words[k]
            if word == "{":
                end = block(k)
                blocks.append((k + 1, end))
                k = end + 1
                continue
            if word in ("if", "ifelse"):
                test = stack.pop()
                yes = run(*blocks[-2 if word == "ifelse" else -1], list(stack))
                no = run(*blocks[-1], list(stack)) if word == "ifelse" else list(stack)
                if len(yes) != len(no):
                    raise ValueError("the branches leave stacks of different depth")
                stack = [a if a is b else F.when(test, a).otherwise(b) for a, b in zip(yes, no, strict=True)]
                blocks = []
            elif word in two:
                b, a = stack.pop(), stack.pop()
                stack.append(two[word](a, b))
            elif word in one:
                stack.append(one[word](stack.pop()))
            elif word == "dup":
                stack.append(stack[-1])
            elif word == "exch":
                stack[-2:] = stack[-1], stack[-2]
            elif word == "pop":
                stack.pop()
            elif word in ("copy", "index", "roll"):
                n = int(stack.pop())
                if word == "copy":
                    stack += stack[len(stack) - n :]
                elif word == "index":
                    stack.append(stack[-1 - n])
                else:
                    size = int(stack.pop())
                    top = stack[len(stack) - size :]
                    stack[len(stack) - size :] = top[-n % size :] + top[: -n % size]
            elif word in ("true", "false"):
                stack.append(F.lit(word == "true"))
            else:
                follows = words[k + 1] if k + 1 < hi else ""
                following = words[k + 2] if k + 2 < hi else ""
                literal = follows in ("copy", "index", "roll") or following == "roll"
                stack.append(int(word) if literal else F.lit(float(word)))
            k += 1
        return stack

    return run(0, len(words), stack)
