"""Functions of page descriptions: sampled, exponential, stitched, calculated; over numpy rows or columns."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def between(x: np.ndarray, low: float, high: float, to_low: float, to_high: float) -> np.ndarray:
    return np.full_like(x, to_low) if high == low else to_low + (x - low) * (to_high - to_low) / (high - low)


@dataclass
class Function:
    """domain and range: a (low, high) for each input and output; range may be left out."""

    domain: list[tuple[float, float]]
    range: list[tuple[float, float]] = field(default_factory=list)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        """(rows x inputs) to (rows x outputs), both clamped; inputs that are missing take the low end."""
        x = np.column_stack([np.clip(rows[:, i] if i < rows.shape[1] else np.full(len(rows), low), low, high) for i, (low, high) in enumerate(self.domain)])
        out = self.value(x)
        for j, (low, high) in enumerate(self.range[: out.shape[1]]):
            out[:, j] = np.clip(out[:, j], low, high)
        return out

    def value(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError


@dataclass
class Exponential(Function):
    c0: list[float] = field(default_factory=lambda: [0.0])
    c1: list[float] = field(default_factory=lambda: [1.0])
    n: float = 1.0

    def value(self, x: np.ndarray) -> np.ndarray:
        c0, c1 = np.array(self.c0), np.array(self.c1)
        with np.errstate(all="ignore"):
            power = np.nan_to_num(np.power(x[:, :1], self.n))
        return c0 + power * (c1 - c0)


@dataclass
class Stitched(Function):
    functions: list[Function] = field(default_factory=list)
    bounds: list[float] = field(default_factory=list)
    encode: list[tuple[float, float]] = field(default_factory=list)

    def value(self, x: np.ndarray) -> np.ndarray:
        which = np.minimum(np.searchsorted(self.bounds, x[:, 0], "right"), len(self.functions) - 1)
        edges = [self.domain[0][0], *self.bounds, self.domain[0][1]]
        out = None
        for k, f in enumerate(self.functions):
            own = f(between(x[:, :1], edges[k], edges[k + 1], *self.encode[k]))
            out = own if out is None else np.where((which == k)[:, None], own, out)
        return out


@dataclass
class Sampled(Function):
    """A grid of samples of `bits` bits each, the first input running fastest; values between are interpolated in all inputs."""

    size: list[int] = field(default_factory=list)
    bits: int = 8
    encode: list[tuple[float, float]] = field(default_factory=list)
    decode: list[tuple[float, float]] = field(default_factory=list)
    data: bytes = b""

    def __post_init__(self) -> None:
        self.encode = self.encode or [(0.0, n - 1.0) for n in self.size]
        self.decode = self.decode or self.range
        outputs, count = len(self.range), math.prod(self.size)
        need = count * outputs * self.bits
        stream = np.unpackbits(np.frombuffer(self.data.ljust(-(-need // 8), b"\0"), np.uint8))[:need].reshape(-1, self.bits)
        self.samples = (stream @ (2.0 ** np.arange(self.bits - 1, -1, -1))).reshape(count, outputs) / (2.0**self.bits - 1)

    def value(self, x: np.ndarray) -> np.ndarray:
        at = [np.clip(between(x[:, i], *self.domain[i], *self.encode[i]), 0, n - 1) for i, n in enumerate(self.size)]
        low = [np.minimum(a.astype(int), max(n - 2, 0)) for a, n in zip(at, self.size)]
        part = [a - b if n > 1 else np.zeros_like(a) for a, b, n in zip(at, low, self.size)]
        strides = np.cumprod([1, *self.size[:-1]])
        out = np.zeros((len(x), self.samples.shape[1]))
        for corner in range(1 << len(self.size)):
            weight, place = np.ones(len(x)), np.zeros(len(x), int)
            for i, n in enumerate(self.size):
                upper = corner >> i & 1
                weight = weight * (part[i] if upper else 1 - part[i])
                place = place + np.minimum(low[i] + upper, n - 1) * strides[i]
            out += weight[:, None] * self.samples[place]
        return np.column_stack([between(out[:, j], 0, 1, *self.decode[j]) for j in range(out.shape[1])])


def whole(x: float) -> int:
    return int(x)


def both(on_flags: Callable, on_bits: Callable) -> Callable:
    return lambda a, b: on_flags(a, b) if isinstance(a, bool) and isinstance(b, bool) else on_bits(whole(a), whole(b))


# The calculator's words that take one or two operands and give one result
UNARY: dict[str, Callable] = {
    "abs": abs, "neg": lambda a: -a, "ceiling": math.ceil, "floor": math.floor, "round": lambda a: math.floor(a + 0.5), "truncate": math.trunc, "cvi": math.trunc, "cvr": float, "sqrt": math.sqrt,
    "sin": lambda a: math.sin(math.radians(a)), "cos": lambda a: math.cos(math.radians(a)), "ln": math.log, "log": math.log10, "not": lambda a: not a if isinstance(a, bool) else ~whole(a),
}
BINARY: dict[str, Callable] = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b, "idiv": lambda a, b: whole(whole(a) / whole(b)), "mod": lambda a, b: math.fmod(whole(a), whole(b)),
    "exp": lambda a, b: a**b, "atan": lambda a, b: math.degrees(math.atan2(a, b)) % 360, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b, "and": both(lambda a, b: a and b, lambda a, b: a & b), "or": both(lambda a, b: a or b, lambda a, b: a | b), "xor": both(lambda a, b: a != b, lambda a, b: a ^ b),
    "bitshift": lambda a, b: whole(a) << whole(b) if b >= 0 else whole(a) >> -whole(b),
}


def read_program(text: str) -> list:
    """Numbers, words, and lists for what stands in braces."""
    stack: list[list] = [[]]
    for t in re.findall(r"[{}]|[^\s{}]+", re.sub(r"%[^\r\n]*", "", text)):
        if t == "{":
            stack.append([])
        elif t == "}":
            inner = stack.pop()
            if not stack:
                raise ValueError("a brace closes what none has opened")
            stack[-1].append(inner)
        else:
            stack[-1].append(float(t) if re.fullmatch(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", t) else t == "true" if t in ("true", "false") else t)
    if len(stack) != 1:
        raise ValueError("a brace stays open")
    return stack[0][0] if len(stack[0]) == 1 and isinstance(stack[0][0], list) else stack[0]


def run_program(program: list, stack: list) -> None:
    for k, word in enumerate(program):
        if not isinstance(word, str):
            if not isinstance(word, list):
                stack.append(word)
            continue
        if word in UNARY:
            stack.append(UNARY[word](stack.pop()))
        elif word in BINARY:
            b, a = stack.pop(), stack.pop()
            stack.append(BINARY[word](a, b))
        elif word == "if":
            if stack.pop():
                run_program(program[k - 1], stack)
        elif word == "ifelse":
            run_program(program[k - 2] if stack.pop() else program[k - 1], stack)
        elif word == "pop":
            stack.pop()
        elif word == "exch":
            stack[-1], stack[-2] = stack[-2], stack[-1]
        elif word == "dup":
            stack.append(stack[-1])
        elif word == "index":
            n = whole(stack.pop())
            stack.append(stack[-1 - n] if n >= 0 else stack[len(stack)])
        elif word == "copy":
            n = whole(stack.pop())
            stack += stack[len(stack) - n :] if n > 0 else []
        elif word == "roll":
            j, n = whole(stack.pop()), whole(stack.pop())
            if n > 0:
                own = stack[-n:]
                if len(own) < n:
                    raise IndexError("too few to roll")
                stack[-n:] = own[-j % n :] + own[: -j % n]
        else:
            raise ValueError(f"unknown word {word}")


@dataclass
class Calculated(Function):
    program: list = field(default_factory=list)

    def value(self, x: np.ndarray) -> np.ndarray:
        """The last results on the stack; a row that fails gives zeros, one with too few fills from the end."""
        n = len(self.range)
        out = np.zeros((len(x), n))
        for i, row in enumerate(x.tolist()):
            stack: list = list(row)
            try:
                run_program(self.program, stack)
            except (ArithmeticError, IndexError, TypeError, ValueError):
                continue
            got = [float(v) for v in stack[-n:]]
            out[i, n - len(got) :] = got
        return out


@dataclass
class Combined(Function):
    """The first outputs of several functions of the same inputs."""

    functions: list[Function] = field(default_factory=list)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return np.column_stack([f(rows)[:, 0] for f in self.functions])


def pairs(values: list | None) -> list[tuple[float, float]]:
    own = [float(v) for v in values or []]
    return list(zip(own[::2], own[1::2]))


def function_of(get: Callable, found: object, decoded: Callable[[object], bytes] = lambda s: b"", inside: tuple = ()) -> Function:
    """Of an object of a page description; get() resolves references, decoded() gives a stream's bytes. One that holds itself is an error."""
    own = get(found)
    if isinstance(own, list):
        return Combined([], [], [function_of(get, f, decoded, inside) for f in own])
    if id(own) in inside:
        raise ValueError("a function holds itself")
    inside = (*inside, id(own))
    listed = lambda name, default=None: [get(v) for v in get(own.get(name), None) or default or []]
    domain, to, kind = pairs(listed("Domain")), pairs(listed("Range")), get(own.get("FunctionType"))
    if kind == 0:
        return Sampled(domain, to, [int(n) for n in listed("Size")], int(get(own.get("BitsPerSample"), 8)), pairs(listed("Encode")), pairs(listed("Decode")), decoded(own))
    if kind == 2:
        return Exponential(domain, to, [float(v) for v in listed("C0", [0.0])], [float(v) for v in listed("C1", [1.0])], float(get(own.get("N"), 1)))
    if kind == 3:
        return Stitched(domain, to, [function_of(get, f, decoded, inside) for f in listed("Functions")], [float(v) for v in listed("Bounds")], pairs(listed("Encode")))
    if kind == 4:
        return Calculated(domain, to, read_program(decoded(own).decode("latin-1")))
    raise ValueError(f"unsupported function type {kind}")


def evaluated(f: Function, *inputs: Column) -> Column:
    """The outputs of f over columns, as an array; null inputs count as 0."""

    @F.arrow_udf("array<double>")
    def run(*columns: pa.Array) -> pa.Array:
        rows = np.column_stack([c.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns])
        out = f(rows)
        return pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1], out.ravel())

    return run(*inputs)
