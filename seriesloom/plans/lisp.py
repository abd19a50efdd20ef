"""An s-expression front end: text to panel operators. Nothing runs until a result is used.

Forms: quote, if, let, let*, progn, define / defparameter / setf, lambda, defmacro with quasiquote, the threading
arrow, and calls. In a call of a panel operator the panel may stand before or behind the other arguments.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from ..frame import Panel
from ..sources import csvfile

#: Tokens of the language, and the operators of the registry they call.
TOKENS = {
    "+": "add", "-": "sub", "*": "mul", "/": "div", ">": "gt", "<": "lt", ">=": "ge", "<=": "le", "==": "eq", "!=": "ne",
    "log": "log", "exp": "exp", "sqrt": "sqrt", "abs": "abs", "inv": "inv", "inc": "inc", "dec": "dec", "chop": "chop",
    "dlog": "dlog", "dlog-obs": "dlog", "dlog-ofs": "dlog_ofs", "dlog-col": "dlog", "dlog-cols": "dlog_ofs", "ret": "ret", "locf": "locf",
    "locf-cols": "locf", "shift": "shift", "shift-col": "shift", "shift-cols": "shift", "lag-obs": "lag_obs", "shift-obs": "lag_obs",
    "diff": "diff", "diff-col": "diff", "diff-cols": "diff", "keep": "keep", "keep-shape": "keep", "keep-shape-cols": "keep",
    "cs1": "cs1", "cs1-col": "cs1", "cs1-cols": "cs1_carry", "ecs1": "ecs1", "ecs1-cols": "ecs1", "ecs1-col": "ecs1",
    "rolling-mean": "rolling_mean", "rolling-std": "rolling_std", "rolling-mean-min2": "rolling_mean_min2",
    "rolling-std-min2": "rolling_std_min2", "rolling-zscore": "rolling_zscore", "wzs": "wzs", "ft-mean": "ft_mean",
    "ft-std": "ft_std", "ft-zscore": "ft_zscore", "ur": "ur", "ur-col": "ur_step", "ur-cols": "ur_step", "wz0": "wz0_next",
    "wz0-cols": "wz0", "wstd": "wstd", "wstd-cols": "wstd", "wstd0": "wstd0", "wstd0-cols": "wstd0", "wv": "wv", "wv-cols": "wv",
    "wq": "wq", "zscore": "zscore", "ft-wmoments-cols": "ft_wmoments", "ft-wmean-cols": "ft_wmean", "ft-wstd-cols": "ft_wstd",
    "ft-wskew-cols": "ft_wskew", "ft-wkurt-cols": "ft_wkurt", "wkd": "wkd", "w5": "wkd", "mask-weekend": "mask_weekend",
    "with-mask": "with_mask", "mask-on": "mask_on", "mask-off": "mask_off", "mask-define": "mask_define",
    "mask-list": "mask_list", "mask-stats": "mask_stats", "mapr": "mapr", "asofr": "asofr", "xminus": "xminus", "x-": "xminus",
    "sum": "total", "sum0": "sum0", "mean": "mean", "avg": "mean", "mean0": "mean0", "std": "std", "std_dev": "std", "std0": "std0",
    "ir": "information_ratio", "ir2": "information_ratio", "o": "o", "ro": "ro", "select": "select", "col": "col",
    "w": "column_at", "select-num": "select_num", "cols": "cols", "len": "length", "setcol": "setcol", "withcol": "withcol",
    "map-cols": "map_cols", "apply-cols": "apply_cols",
    ">-cols": "gt", ">-col": "gt", "d": "diff", "ts": "shift", "xm": "xminus", "wavg": "wmean", "wmean-cols": "wmean", "wm": "ft_wmean",
}
_NUMBERS: dict[str, Callable] = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, ">": lambda a, b: float(a > b), "<": lambda a, b: float(a < b), ">=": lambda a, b: float(a >= b), "<=": lambda a, b: float(a <= b), "==": lambda a, b: float(a == b), "!=": lambda a, b: float(a != b)}
_token = re.compile(r"""\s*(?:;[^\n]*)?(?:(,@|[()'`,])|"((?:\\.|[^"\\])*)"|([^\s()'`,;"]+)|$)""", re.S)
_QUOTES = {"'": "quote", "`": "quasiquote", ",": "unquote", ",@": "unquote-splicing"}
MACRO_STEPS = 1000


class Sym(str):
    """A symbol; strings of the language are plain str."""


def read(text: str) -> list[Any]:
    """All forms of a text."""
    tokens: list[tuple[str, str]] = []
    at = 0
    while at < len(text):
        m = _token.match(text, at)
        if not m:
            raise SyntaxError(f"cannot read at {text[at:at + 20]!r}")
        if m.end() == at:
            at += 1
            continue
        at = m.end()
        if m[1]:
            tokens.append(("mark", m[1]))
        elif m[2] is not None:
            tokens.append(("string", re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), m[2])))
        elif m[3]:
            tokens.append(("atom", m[3]))
    forms, i = [], 0
    while i < len(tokens):
        form, i = _form(tokens, i)
        forms.append(form)
    return forms


def _form(tokens: list[tuple[str, str]], i: int) -> tuple[Any, int]:
    if i >= len(tokens):
        raise SyntaxError("a form is not closed")
    kind, value = tokens[i]
    if kind == "string":
        return value, i + 1
    if kind == "atom":
        return _atom(value), i + 1
    if value in _QUOTES:
        inner, i = _form(tokens, i + 1)
        return [Sym(_QUOTES[value]), inner], i
    if value == ")":
        raise SyntaxError("a closing parenthesis too many")
    out, i = [], i + 1
    while i < len(tokens) and tokens[i] != ("mark", ")"):
        form, i = _form(tokens, i)
        out.append(form)
    if i >= len(tokens):
        raise SyntaxError("a form is not closed")
    return out, i + 1


def _atom(x: str) -> Any:
    if x in ("nil", "t", "true"):
        return None if x == "nil" else True
    for kind in (int, float):
        try:
            return kind(x)
        except ValueError:
            continue
    return Sym(x)


def truthy(x: Any) -> bool:
    """Only nil and false are false."""
    return x is not None and x is not False


class Session:
    """Evaluates forms; names bound by define stay."""

    def __init__(self, spark: SparkSession, **names: Any):
        self.spark, self.names, self.macros = spark, dict(names), {}

    def run(self, text: str) -> Any:
        out = None
        for form in read(text):
            out = self.eval(form, {})
        return out

    def eval(self, x: Any, local: dict) -> Any:
        if isinstance(x, Sym):
            if x in local:
                return local[x]
            if x in self.names:
                return self.names[x]
            raise NameError(f"{x} has no value")
        if not isinstance(x, list):
            return x
        if not x:
            return None
        head, *args = x
        if isinstance(head, Sym):
            special = getattr(self, f"_f_{_method(head)}", None)
            if special:
                return special(args, local)
            if head in self.macros:
                return self.eval(self._expand(x), local)
        elif isinstance(head, list):
            return self.eval(head, local)(*[self.eval(a, local) for a in args])
        if head in local or head in self.names:
            return self.eval(head, local)(*[self.eval(a, local) for a in args])
        return self.call(str(head), [self.eval(a, local) for a in args])

    def call(self, name: str, args: list[Any]) -> Any:
        if name in ("file", "load", "read-csv"):
            return csvfile.read_csv(self.spark, args[0])
        if name == "file-head":
            return csvfile.read_csv(self.spark, args[0], head=args[1])
        if name == "stdin":
            return csvfile.read_stdin(self.spark)
        if name == "save":
            return csvfile.write_csv(next(a for a in args if isinstance(a, Panel)), next(a for a in args if isinstance(a, str)))
        if name in ("print", "dump"):
            for a in args:
                csvfile.print_table(a) if isinstance(a, Panel) else print(a, end=" ")
            return None
        if name == "make-col":
            from ..operators.columns import make_col

            return make_col(self.spark, *args)
        if name == "type-of":
            from ..operators.columns import type_of

            return type_of(args[0])
        panels = [a for a in args if isinstance(a, Panel)]
        if not panels:
            if name in _NUMBERS and len(args) == 2:
                return _NUMBERS[name](*args)
            raise NameError(f"{name} is no function of {args!r}")
        if name not in TOKENS:
            raise NameError(f"no operator {name}")
        first = next(i for i, a in enumerate(args) if isinstance(a, Panel))
        if first and name in _NUMBERS:
            raise TypeError(f"({name} ...) takes its panel first")
        rest = [_plain(a) for i, a in enumerate(args) if i != first]
        if name == "withcol":
            rest[1] = TOKENS.get(rest[1], rest[1])
        return getattr(panels[0], TOKENS[name])(*rest)

    # -- special forms

    def _f_quote(self, args, local):
        return args[0]

    def _f_if(self, args, local):
        test, yes, no = args
        return self.eval(yes if truthy(self.eval(test, local)) else no, local)

    def _f_progn(self, args, local):
        out = None
        for a in args:
            out = self.eval(a, local)
        return out

    def _f_let(self, args, local):
        inner = dict(local)
        bindings, *body = args
        for name, value in bindings:
            inner[name] = self.eval(value, inner)
        return self._f_progn(body, inner)

    _f_let_star = _f_let

    def _f_define(self, args, local):
        self.names[args[0]] = self.eval(args[1], local)
        return self.names[args[0]]

    _f_defparameter = _f_setf = _f_define

    def _f_lambda(self, args, local):
        names, *body = args

        def f(*values):
            if len(values) != len(names):
                raise TypeError(f"a function of {len(names)} got {len(values)}")
            return self._f_progn(body, local | dict(zip(names, values)))

        return f

    def _f_when(self, args, local):
        return self._f_progn(args[1:], local) if truthy(self.eval(args[0], local)) else None

    def _f_unless(self, args, local):
        return None if truthy(self.eval(args[0], local)) else self._f_progn(args[1:], local)

    def _f_and(self, args, local):
        out: Any = True
        for a in args:
            out = self.eval(a, local)
            if not truthy(out):
                break
        return out

    def _f_or(self, args, local):
        out: Any = None
        for a in args:
            out = self.eval(a, local)
            if truthy(out):
                break
        return out

    def _f_arrow(self, args, local):
        first, *forms = args
        for f in forms:
            first = [f[0], first, *f[1:]] if isinstance(f, list) else [f, first]
        return self.eval(first, local)

    def _f_defmacro(self, args, local):
        name, params, *body = args
        self.macros[name] = (params, body)

    def _f_quasiquote(self, args, local):
        return self._fill(args[0], local)

    def _f_macroexpand(self, args, local):
        form, steps = self.eval(args[0], local), 0
        while isinstance(form, list) and form and isinstance(form[0], Sym) and form[0] in self.macros:
            form, steps = self._expand(form), steps + 1
            if steps > MACRO_STEPS:
                raise RecursionError("a macro expands without end")
        return form

    def _expand(self, form: list) -> Any:
        params, body = self.macros[form[0]]
        if len(params) != len(form) - 1:
            raise TypeError(f"macro {form[0]} takes {len(params)} forms")
        return self._f_progn(body, dict(zip(params, form[1:])))

    def _fill(self, x: Any, local: dict) -> Any:
        if not isinstance(x, list) or not x:
            return x
        if x[0] == "unquote" and isinstance(x[0], Sym):
            return self.eval(x[1], local)
        out = []
        for part in x:
            if isinstance(part, list) and part and isinstance(part[0], Sym) and part[0] == "unquote-splicing":
                out.extend(self.eval(part[1], local))
            else:
                out.append(self._fill(part, local))
        return out


def _method(name: str) -> str:
    return {"->": "arrow", "let*": "let_star"}.get(name, name.replace("-", "_"))


def _plain(x: Any) -> Any:
    """Quoted lists as tuples, symbols as strings: what operators take."""
    return tuple(_plain(v) for v in x) if isinstance(x, list) else str(x) if isinstance(x, Sym) else x
