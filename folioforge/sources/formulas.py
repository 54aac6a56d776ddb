"""Functions of a document: sampled, exponential, stitching and calculator ones, as callables of numbers.

Inputs are clamped to the domain and outputs to the range.  What is malformed makes no function.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable

from .fonts import number
from .objects import File, Stream

INPUTS_MOST, OUTPUTS_MOST, NESTED_MOST, NODES_MOST, STEPS_MOST, STACK_MOST = 8, 64, 16, 256, 1 << 20, 100
SAMPLES_MOST = 1 << 22
WORDS = re.compile(rb"%[^\r\n]*|([{}]|[^\0\t\n\f\r {}%]+)")


class NoFunction(ValueError):
    pass


def pairs(values) -> list[tuple[float, float]]:
    if not isinstance(values, list) or len(values) < 2 or len(values) % 2 or None in (found := [number(v) for v in values]):
        raise NoFunction("pairs of numbers")
    return list(zip(found[::2], found[1::2], strict=True))


def clamp(v: float, low: float, high: float) -> float:
    """NaN becomes the lower end."""
    return low if not v >= low else min(v, high)


def between(x: float, low: float, high: float, to_low: float, to_high: float) -> float:
    return to_low if high == low else to_low + (x - low) * (to_high - to_low) / (high - low)


class Function:
    """domain, range (empty: not clamped), and the rule for inputs within the domain."""

    def __init__(self, kind: int, domain: list[tuple[float, float]], limits: list[tuple[float, float]], rule: Callable[[list[float]], list[float]], outputs: int):
        self.kind, self.domain, self.limits, self.rule, self.outputs = kind, domain, limits, rule, outputs

    def __call__(self, inputs: list[float]) -> list[float]:
        inputs = [clamp(inputs[k] if k < len(inputs) else 0.0, *d) for k, d in enumerate(self.domain)]
        out = self.rule(inputs)
        return [clamp(v, *r) for v, r in zip(out, self.limits, strict=False)] if self.limits else out


def parsed(file: File, value, depth: int = 0, nodes: list[int] | None = None) -> Function:
    """The function that a dictionary or stream describes."""
    nodes = nodes if nodes is not None else [0]
    nodes[0] += 1
    value = file.get(value)
    entries = value.entries if isinstance(value, Stream) else value
    if not isinstance(entries, dict) or depth > NESTED_MOST or nodes[0] > NODES_MOST:
        raise NoFunction("not a function")
    get = lambda k: _resolved(file, file.get(entries.get(k)))
    domain, limits = pairs(get("Domain")), pairs(get("Range")) if get("Range") is not None else []
    if len(domain) > INPUTS_MOST or len(limits) > OUTPUTS_MOST:
        raise NoFunction("too many inputs or outputs")
    kind = get("FunctionType")
    if kind == 0 and isinstance(value, Stream) and limits:
        return Function(0, domain, limits, _sampled(file, value, get, domain, limits), len(limits))
    if kind == 2 and len(domain) == 1:
        low, high, power = get("C0") or [0.0], get("C1") or [1.0], number(get("N"))
        low, high = [number(v) for v in low], [number(v) for v in high]
        if power is None or len(low) != len(high) or None in low + high:
            raise NoFunction("exponential")
        return Function(2, domain, limits, lambda x: [a + _power(x[0], power) * (b - a) for a, b in zip(low, high, strict=True)], len(low))
    if kind == 3 and len(domain) == 1:
        parts = [parsed(file, p, depth + 1, nodes) for p in get("Functions") or []]
        bounds, encode = [number(v) for v in get("Bounds") or []], pairs(get("Encode"))
        if not parts or len(bounds) != len(parts) - 1 or None in bounds or len(encode) < len(parts):
            raise NoFunction("stitching")
        edges = [domain[0][0], *bounds, domain[0][1]]

        def rule(x: list[float]) -> list[float]:
            k = next((k for k, b in enumerate(bounds) if x[0] < b), len(parts) - 1)
            return parts[k]([between(x[0], edges[k], edges[k + 1], *encode[k])])

        return Function(3, domain, limits, rule, parts[0].outputs)
    if kind == 4 and isinstance(value, Stream) and limits:
        program = compiled(file.content(value))

        def run(x: list[float]) -> list[float]:
            stack = calculated(program, x)
            n = len(limits)
            return [float(v) for v in [0.0] * (n - len(stack)) + stack[-n:]]

        return Function(4, domain, limits, run, len(limits))
    raise NoFunction("unknown kind")


def _resolved(file: File, value):
    return [file.get(v) for v in value] if isinstance(value, list) else value


def _power(x: float, n: float) -> float:
    try:
        return x**n if x >= 0 or n == int(n) else math.nan
    except (OverflowError, ZeroDivisionError):
        return math.inf


def _sampled(file: File, stream: Stream, get, domain, limits) -> Callable[[list[float]], list[float]]:
    size, bits = get("Size"), get("BitsPerSample")
    if not isinstance(size, list) or len(size) != len(domain) or not all(isinstance(s, int) and s > 0 for s in size) or bits not in (1, 2, 4, 8, 12, 16, 24, 32):
        raise NoFunction("sampled")
    m, n = len(domain), len(limits)
    total = math.prod(size) * n
    if total > SAMPLES_MOST:
        raise NoFunction("too many samples")
    encode = pairs(get("Encode")) if get("Encode") is not None else [(0.0, s - 1.0) for s in size]
    decode = pairs(get("Decode")) if get("Decode") is not None else limits
    data = file.content(stream)
    whole, need = int.from_bytes(data[: (total * bits + 7) // 8].ljust((total * bits + 7) // 8, b"\0"), "big") if bits in (1, 2, 4, 12) else 0, (total * bits + 7) // 8
    width, most = need * 8, (1 << bits) - 1

    def sample(k: int) -> int:
        if bits in (8, 16, 24, 32):
            return int.from_bytes(data[k * bits // 8 : (k + 1) * bits // 8].ljust(bits // 8, b"\0"), "big")
        return whole >> (width - (k + 1) * bits) & most

    steps = list(itertools.accumulate([1, *size[:-1]], lambda a, b: a * b))

    def rule(x: list[float]) -> list[float]:
        at = [clamp(between(v, *domain[k], *encode[k]), 0.0, size[k] - 1.0) for k, v in enumerate(x)]
        low = [min(int(a), max(size[k] - 2, 0)) for k, a in enumerate(at)]
        out = [0.0] * n
        for corner in itertools.product((0, 1), repeat=m):
            weight = math.prod((a - b) if c else 1 - (a - b) for a, b, c in zip(at, low, corner, strict=True))
            if weight:
                cell = sum(min(b + c, s - 1) * step for b, c, s, step in zip(low, corner, size, steps, strict=True))
                for j in range(n):
                    out[j] += weight * sample(cell * n + j)
        return [between(v, 0.0, float(most), *decode[j]) for j, v in enumerate(out)]

    return rule


def compiled(data: bytes) -> list:
    """A calculator program as nested lists of numbers and words."""
    words = [m[1].decode("latin-1") for m in WORDS.finditer(data) if m[1]]
    if not words or words[0] != "{" or len(words) > 1 << 16:
        raise NoFunction("a program begins with a brace")
    stack: list[list] = [[]]
    for word in words:
        if word == "{":
            if len(stack) > NESTED_MOST * 2:
                raise NoFunction("nested too deeply")
            stack.append([])
        elif word == "}":
            if len(stack) < 2:
                raise NoFunction("a brace too many")
            done = stack.pop()
            stack[-1].append(done)
            if len(stack) == 1:
                return done
        else:
            try:
                stack[-1].append(float(word))
            except ValueError:
                if word not in OPERATORS:
                    raise NoFunction(f"unknown word {word}") from None
                stack[-1].append(word)
    raise NoFunction("the program does not end")


class _Stops(Exception):
    pass


def _whole(v) -> int:
    """A 32-bit integer: truncated and saturated, NaN as 0."""
    v = float(v)
    return 0 if math.isnan(v) else int(max(-(2.0**31), min(2.0**31 - 1, v)))


def _signed(v: int) -> float:
    return float((v + (1 << 31)) % (1 << 32) - (1 << 31))


def _divided(a, b) -> float:
    a, b = float(a), float(b)
    return a / b if b else math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a) * math.copysign(1.0, b)


def _quiet(f: Callable[[float], float]) -> Callable[[float], float]:
    def run(v):
        try:
            return f(float(v))
        except (ValueError, OverflowError):
            return math.nan

    return run


def _truncated(f):
    return lambda v: float(f(v)) if math.isfinite(float(v)) else float(v)


def _stop_at_zero(f):
    def run(a, b):
        a, b = _whole(a), _whole(b)
        if not b:
            raise _Stops
        return _signed(f(a, b))

    return run


def _bits(of_bools, of_ints):
    return lambda a, b: of_bools(a, b) if isinstance(a, bool) and isinstance(b, bool) else _signed(of_ints(_whole(a), _whole(b)))


def _shifted(a, b) -> float:
    a, b = _whole(a), _whole(b)
    if abs(b) >= 32:
        return 0.0
    return _signed(a << b) if b >= 0 else float((a & 0xFFFFFFFF) >> -b)


def _same(a, b) -> bool:
    return isinstance(a, bool) == isinstance(b, bool) and a == b


ONE: dict[str, Callable] = {
    "abs": lambda a: abs(float(a)),
    "neg": lambda a: -float(a),
    "ceiling": _truncated(math.ceil),
    "floor": _truncated(math.floor),
    "round": _truncated(lambda v: math.floor(v + 0.5) if v >= 0 else math.ceil(v - 0.5)),
    "truncate": _truncated(math.trunc),
    "sqrt": _quiet(math.sqrt),
    "sin": _quiet(lambda v: math.sin(math.radians(v))),
    "cos": _quiet(lambda v: math.cos(math.radians(v))),
    "ln": _quiet(lambda v: math.log(v) if v else -math.inf),
    "log": _quiet(lambda v: math.log10(v) if v else -math.inf),
    "cvi": lambda a: float(_whole(a)),
    "cvr": float,
    "not": lambda a: not a if isinstance(a, bool) else _signed(~_whole(a)),
}
TWO: dict[str, Callable] = {
    "add": lambda a, b: float(a) + float(b),
    "sub": lambda a, b: float(a) - float(b),
    "mul": lambda a, b: float(a) * float(b),
    "div": _divided,
    "idiv": _stop_at_zero(lambda a, b: int(math.copysign(abs(a) // abs(b), a * b)) if a else 0),
    "mod": _stop_at_zero(lambda a, b: int(math.copysign(abs(a) % abs(b), a)) if a else 0),
    "atan": lambda a, b: math.degrees(math.atan2(float(a), float(b))) % 360.0,
    "exp": lambda a, b: _power(float(a), float(b)),
    "eq": _same,
    "ne": lambda a, b: not _same(a, b),
    "gt": lambda a, b: float(a) > float(b),
    "ge": lambda a, b: float(a) >= float(b),
    "lt": lambda a, b: float(a) < float(b),
    "le": lambda a, b: float(a) <= float(b),
    "and": _bits(lambda a, b: a and b, lambda a, b: a & b),
    "or": _bits(lambda a, b: a or b, lambda a, b: a | b),
    "xor": _bits(lambda a, b: a != b, lambda a, b: a ^ b),
    "bitshift": _shifted,
}
OPERATORS = {*ONE, *TWO, "true", "false", "if", "ifelse", "copy", "dup", "exch", "index", "pop", "roll"}


def calculated(program: list, inputs: list[float]) -> list:
    """The stack that a program leaves.  What fails stops it: the stack then stays as it is."""
    stack: list = list(inputs)
    steps = 0

    def pop():
        if not stack:
            raise _Stops
        return stack.pop()

    def run(block: list) -> None:
        nonlocal steps
        for k, word in enumerate(block):
            steps += 1
            if steps > STEPS_MOST:
                raise _Stops
            if isinstance(word, float):
                stack.append(word)
            elif isinstance(word, list):
                if not (k + 1 < len(block) and block[k + 1] in ("if", "ifelse") or k + 2 < len(block) and isinstance(block[k + 1], list) and block[k + 2] == "ifelse"):
                    raise _Stops
            elif word == "if":
                if pop():
                    run(block[k - 1])
            elif word == "ifelse":
                run(block[k - 2] if pop() else block[k - 1])
            elif word in ONE:
                stack.append(ONE[word](pop()))
            elif word in TWO:
                b, a = pop(), pop()
                stack.append(TWO[word](a, b))
            elif word in ("true", "false"):
                stack.append(word == "true")
            elif word == "pop":
                pop()
            elif word == "dup":
                stack.append(pop())
                stack.append(stack[-1])
            elif word == "exch":
                b, a = pop(), pop()
                stack.extend((b, a))
            else:
                n = _whole(pop())
                if word == "roll":
                    n, turn = _whole(pop()), n
                    if not 0 <= n <= len(stack):
                        raise _Stops
                    if n and (turn := turn % n):
                        stack[-n:] = stack[-turn:] + stack[-n:-turn]
                elif not 0 <= n <= len(stack) - (word == "index"):
                    raise _Stops
                elif word == "copy":
                    stack.extend(stack[len(stack) - n :])
                else:
                    stack.append(stack[-1 - n])
            if len(stack) > STACK_MOST:
                del stack[STACK_MOST:]
                raise _Stops

    try:
        run(program)
    except _Stops:
        pass
    return stack
