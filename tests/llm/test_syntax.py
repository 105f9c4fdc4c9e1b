"""The parsers against held sources: valid ones without errors, broken ones with, and Python against its own compiler."""

import ast
import random
import warnings

import pytest

from symbolith.llm import syntax
from symbolith.llm.grammars import pairs
from symbolith.llm.syntax.core import line_at, line_of

VALID = {
    "js": [
        "", "  \n", "import a, { b as c } from 'x';\nexport default function* f(a = 1, ...b) { yield* a; }\n", "const f = async (a, { b, c: [d] = [] }) => ({ ...a, [b]: 1, get x() { return 1; } });\n", "a = b\n++c\nlet x = /[/\\]]+/g.test(s) ? a / b / c : `t ${`n ${1}`} }`;\n",
        "class A extends B { static #p = 1; static { a(); } async *m() { for await (const x of y) {} } get v() { return 1 } 'q'() {} }\n", "label: for (let i = 0, j = 1; i < 3; i++) { if (i) continue label; else break }\n", "const e = <a b='c' {...d}>text {x ? <b/> : null} <></></a>;\n",
        "switch (a) { case 1: case 2: b(); break; default: }\ntry { a() } catch { b() } finally { c() }\n", "a?.b?.[c]?.(d) ?? e ** -f; new A; new a.b(c).d; if (a) ; do x(); while (y) z()\n", "export * as n from 'm'; export { a as default, b }; import('x').then(m => m);\n", "#!/usr/bin/env node\nvar async = 1; async = 2; let of, get, set;\n",
    ],
    "ts": [
        "interface A<T extends B = C> extends D, E { a?: string; readonly b: number[]; (x: T): void; new (y: T): A; [k: string]: any; m?<U>(u: U): U }\n", "type F<T> = T extends (infer U)[] ? U : { [K in keyof T]?: T[K] } | `a${string}` | readonly [a: string, b?: number, ...c: T[]];\n",
        "export abstract class A<T> implements B { constructor(private readonly a: string, public b?: number) { super(); } abstract m(): void; declare x: number; static y!: string; get z(): T { return this.#q as unknown as T } }\n",
        "enum E { A = 1, B, 'c' = 'd' }\ndeclare module 'x' { export function f(a: number): asserts a is 5; }\nnamespace N.M { export const a = 1 }\n", "const f = <T,>(a: T, b: (x: T) => void): a is string => g<T>(a)!;\nlet x = y as const satisfies Z; function o(a: string): void; function o(a: any) {}\n",
        "@dec() export class C { @p() a: string; @q m(@r() x: number) { } }\nlet u = a < b && c > d; let v = a ? (b) : c; for (const [k, w] of Object.entries(x)) {}\n", "import type { A } from 'a'; import { type B, C } from 'b'; export type { D } from 'd'; let a: Promise<Array<Map<string, number>>> = b >> c >>> d;\n",
    ],
    "java": [
        "package a.b;\nimport static java.util.List.*;\n@A(b = {1, 2}) public final class C<T extends D & E> extends F<G> implements H, I { private static final int[] X = {1, 2,}, Y[] = null; static { } C() throws Z { this(1); } <U> U m(final int... a) { return (U) a[0]; } }\n",
        "class A { void f() { int a = b < c ? d : e; List<Map<String, ? super X>> l = new ArrayList<>(); for (var x : l) ; for (int i = 0, j = 1; i < 3; i++, j--) { } do { } while (a > 1); Runnable r = () -> { }; F g = (a1, b1) -> a1 + b1; H h = String::valueOf; I n = int[]::new; } }\n",
        'enum E implements X { A(1) { void f() { } }, B; int v; E(int... v) { } }\ninterface I { default void f() { } int g(); @interface J { int v() default 1; } }\nrecord R<T>(int a, T b) { R { } static int c; }\n',
        'class T { Object f(Object o) { String s = """\n a "b" """; if (o instanceof String t && t.length() > 1) { } return switch (o) { case Integer i when i > 1 -> 1; case R(int a, var b) -> { yield 2; } case null, default -> throw new X(); }; } }\n',
        "class U { void f() { try (A a = b(); c) { } catch (D | E e) { } finally { } synchronized (this) { } x: while (true) break x; a >>>= 2; int[][] q = new int[3][]; (a).b(); new C() { int z; }.go(); long y = (int) -x + (long) (z); } }\n",
    ],
    "cs": [
        "using System;\nusing A = B.C;\nnamespace N { [Serializable] public abstract partial class C<T> : D, E where T : class, new() { public int P { get; private set; } = 1; int this[int i] => i; event A B; ~C() { } public static C operator +(C a, C b) => a; public C() : base(1) { } } }\n",
        'class A { async Task<int> F(ref int a, out string b, params int[] c) { var x = $"{a,5:N2} {{}} {(c ? "y" : "n")}"; var y = @"a ""b"" \\"; await foreach (var z in q) { } return a is int n && n > 1 ? b?.C?[0] ?? throw new X() : d!; } }\n',
        "class B { void F() { int? a = null; (int x, string y) t = (1, \"a\"); var (p, q) = t; Func<int, int> f = x => x + 1; var l = new List<Dictionary<string, int>> { new() { [\"a\"] = 1 } }; using var r = s; lock (o) { } switch (a) { case 1 when b: break; case > 5 and < 7: goto case 1; default: break; } var w = a switch { 1 => 2, _ => 3 }; checked { i++; } int L(int k) => k; } }\n",
        "record R(int A, string B);\nenum E : byte { A = 1, B }\npublic delegate void D(int a);\ninterface I { int P { get; } void M(); }\nvar q = from a in b where a > 1 orderby a descending select a;\n",
    ],
    "go": [
        "package a\n", "package a\n\nimport (\n\t\"b\"\n\tc \"d\"\n)\n\nconst (\n\tA = iota\n\tB\n)\n\nvar x, y int = 1, 2\n\ntype T struct {\n\tA, B int `json:\"a\"`\n\t*E\n\tf func(int) (string, error)\n}\n\ntype I interface {\n\tM(a int, b ...string) error\n\t~int | string\n}\n",
        "package a\n\nfunc (t *T[K]) M(a, b int, c ...string) (n int, err error) {\n\tif x := f(); x != nil && y == (T{1}) {\n\t\treturn\n\t} else if z {\n\t}\n\tfor i := range 10 {\n\t\tcontinue\n\t}\n\tfor {\n\t\tbreak\n\t}\n\tswitch v := x.(type) {\n\tcase int, []string:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase m := <-c:\n\tcase d <- 1:\n\t}\n\tdefer func() { g() }()\n\tgo h(a...)\n\treturn 1, nil\n}\n",
        "package a\n\nfunc G[T any, U comparable](a T) map[string][]U {\n\tm := map[string][]int{\"a\": {1, 2}, \"b\": nil}\n\ts := a[1:2:3]\n\tx, ok := <-c\n\tp := &T{A: 1}\n\t*q = 5\n\ti++\nL:\n\tfor i := 0; i < 3; i++ {\n\t\tgoto L\n\t}\n\treturn make(map[string]int, 3)\n}\n",
    ],
    "rs": [
        "use a::{b, c::*, d as e};\n#![allow(x)]\n" if False else "use a::{b, c::*, d as e};\n", "pub(crate) struct P<'a, T: 'a + Clone, const N: usize>(pub &'a T, [u8; N]) where T: Fn(i32) -> bool;\nenum E { A(u8), B { x: i32 }, C = 5 }\nimpl<T> Tr for P<T> where T: X { type Y = Z; const K: u8 = b'a'; fn f(&mut self) -> Option<Box<dyn Fn(u8) -> u8 + 'static>> { None } }\n",
        'fn main() { let x = if a { 1 } else { 2 }; let Some(y) = z else { return; }; match x { 0..=9 | 20 if b => (), Foo::Bar { a, .. } => {} &(ref c, _) => d?, n @ 1.. => break, _ => unreachable!("a {}", 1), } for i in (0..n).rev() { } while let Some(q) = it.next() { } \'l: loop { break \'l 5; } let c = move |a: u8, &b| -> u8 { a + b }; let v = vec![1; 3]; s.iter().map(|x| x.0 as f32).collect::<Vec<_>>(); }\n',
        "fn g() -> impl Fn() { let r = r#\"a \"b\" {\"#; let c = '\\''; let s = S { a, b: 1, ..d }; a <<= 1; x[1..].len(); unsafe { *p = 1 } if x == (T { a: 1 }) { } || 1 }\nmacro_rules! m { ($a:expr) => { $a }; }\nextern \"C\" { fn h(a: *const u8); }\n/* a /* b */ c */ mod t { #[test] fn u() { assert_eq!(1, 1); } }\ntrait T: A + B { fn d(self: Box<Self>) -> Self where Self: Sized; }\n",
    ],
    "c": [
        "#include <a.h>\n#define M(a) \\\n  do { a } while (0)\n#if 0\nnot c at all {\n#else\nint x;\n#endif\n", "typedef struct node { int a : 3; struct node *next; union { int b; } u; } node_t, *node_p;\nenum e { A = 1, B, };\nstatic const char *const s[] = { \"a\" \"b\", [2] = \"c\" };\nextern int f(void), (*g)(int, char *);\n",
        "int main(int argc, char **argv) { unsigned long x = (unsigned)y + sizeof(struct a) * sizeof b; foo_t *p = (foo_t *)q; for (int i = 0, j; i < 3; i++, j--) ; if (a) b(); else c->d[e].f++; switch (x) { case 1: case 2: break; default: return; } goto out; do { } while (x); out: return (x ? y : z), 0; }\n",
        "void f(int n, int a[static n]) { struct p q = { .x = 1, .y = { 2 } }; g((struct p){ 1, 2 }); *p++ = 'a'; int (*h)(void) = 0; a = b * c; x * y; }\n",
    ],
    "py": ["", "x = 1\n", "def f(a, /, b: int = 1, *c, d, **e) -> x: return (yield a)\n", "match x:\n    case [1, *_] if y: pass\n    case {'a': A(b=c)} | None: pass\n", "with (a as b, c): pass\n", "f'{a!r:>{w}} {{}} {x:%Y}'\n", "async def g():\n\treturn [i async for i in x if i]\n", "type X[T] = list[T]\n", "class A[T](B, metaclass=C):\n    x: int = 1; y = 2\n"],
}
BROKEN = {
    "js": ["function f( {", "let x = ;", "const a;", "if (a {", "`abc ${", "a b", "}", "<<<<<<< HEAD\nlet a = 1;\n=======\n", "class { }", "return x = 'abc", "foo(1, 2", "import slice\nfrom x import y\n", "<!DOCTYPE html>\n<html></html>", "const f = (a => {", "1 = 2", "<a><b></a>"],
    "ts": ["let x: = 1;", "interface A { a: }", "function f(a: string { }", "type = 5 5", "const f = (a: number): => 1;", "#include <stdio.h>\nint x;"],
    "java": ["class A { int f( { } }", "class A { void f() { return 0 } }", "class A { f() { } }", "package a\nclass B { }", "class A { void f() { a.b; } }", "class A {", "class A { } }", "Dear team,", "class A { void f() { String s = \"abc; } }"],
    "cs": ["class A { void F() { return 0 } }", "class A { void F( { } }", "class A {", "class A { F() { } }", 'class A { string s = $"{"; }', "class A { void F() { a.b; } }"],
    "go": ["func f() {}", "package a\nfunc f( {\n}\n", "package a\nimport x\n", "package a\nfunc f() {\n\tx := \n}\n", "package a\nfunc f() {\n", "package a\nx = 1\n", "package a\nfunc f() { if { } }\n", "package a\nvar s = \"abc\n"],
    "rs": ["fn f( {", "fn f() { let x = ; }", "fn f() { ", "struct S { a u8 }", "fn f() { match x { 1 = 2 } }", "pub class X {}", "fn f() -> { }", "let x = 1;"],
    "c": ["int f( {", "int f(void) { return 0 }", "int f(void) {", "#if 1\nint x;\n", "#endif\n", "struct s { int a }", "import x\nfrom y import z\n", "char *s = \"abc;\n", "int x = ;"],
    "py": ["def f(:\n", "x = (1\n", "if a\n    b\n", "def f():\npass\n", "  x = 1\n", "x = 'abc\n", "class :\n", "f'{'\n", "1 = x\n", "<<<<<<< HEAD\n", "import\n", "x = 08\n", "{1: 2, 3}\n", "print 'a'\n"],
}


@pytest.mark.parametrize("extension", sorted(VALID))
def test_valid_sources(extension):
    for text in VALID[extension]:
        assert syntax.check(text, extension) == [], text


@pytest.mark.parametrize("extension", sorted(BROKEN))
def test_broken_sources(extension):
    for text in BROKEN[extension]:
        assert syntax.check(text, extension), text


@pytest.mark.parametrize("extension", sorted(set(VALID) - {"py", "rs"}))
def test_truncation_inside_brackets_is_seen(extension):
    for text in VALID[extension]:
        at = max(text.rfind("{"), 0)
        if at and "`" not in text and "#" not in text:
            assert syntax.check(text[: at + 1], extension), text[: at + 1]


def test_python_agrees_with_its_compiler():
    warnings.simplefilter("ignore")
    source = open(syntax.core.__file__).read() + open(syntax.python.__file__).read()
    rng = random.Random(3)

    def valid(text):
        try:
            compile(text, "x", "exec", flags=ast.PyCF_ONLY_AST, dont_inherit=True)
            return True
        except (SyntaxError, ValueError):
            return False

    assert syntax.check(source, "py") == []
    lines = source.split("\n")
    differ = 0
    for _ in range(120):
        start = rng.randrange(len(lines) - 40)
        text = "\n".join(lines[start : start + 40])
        at = rng.randrange(len(text))
        text = text[:at] + rng.choice(["", "(", ")", ":", "'", "x"]) + text[at + 1 :]
        differ += valid(text) != (not syntax.check(text, "py"))
    assert differ <= 2


def test_recovery_keeps_every_error():
    text = "class A {\n  void f() { int x = ; }\n  void g() { return 0 }\n  int h;\n}\n"
    lines = {line_at(line_of(text), at) for at, _ in syntax.check(text, "java")}
    assert lines == {2, 3}


def test_unknown_deep_and_long_texts():
    assert syntax.check("whatever", "txt") is None
    deep = "x = " + "(" * 6000 + ")" * 6000 + ";"
    assert isinstance(syntax.check(deep, "js"), list)
    assert syntax.check("let a = [" + "1, " * 200_000 + "];", "js") == []


DOCUMENTED = {
    "python": ('def f():\n    "doc"\n    pass\n\nclass A:\n    async def g(\n        self,\n    ) -> x:  # c\n\n        \'\'\'Long\n        doc.\'\'\'\n\ndef h():\n    x = "no"\n\ndef i():\n    "a".join(b)\n\ndef j(): "one line"\n', [1, 6, 19]),
    "javascript": ("/** a */\nexport function f(x) {}\n\n// b\n// c\nconst g = async (x) => 1;\n\n/** d */\n\nfunction no() {}\n\nclass A {\n  /* e */\n  @dec(1)\n  static async m(x = {}) {}\n  // f\n  x = 5;\n  // g\n  if (a) {\n}\n}\nlet s = '/** x */';\n// in\nconst h = function () {};\n", [2, 6, 15, 24]),
    "typescript": ("/** a */\nexport const f = (a: any[], b: number = 1): any => {};\n/** b */\nfunction g<T>(\n  a: T,\n): T {}\nclass A {\n  // c\n  private async m(a: { b: string }): Promise<void> {}\n}\n", [2, 4, 9]),
    "java": ("class A {\n  /** a */\n  @Override\n  public <T> List<T> f(int a) throws X {\n  }\n  // b\n  A(int x) {\n  }\n  /** c */\n  int field;\n  // d\n  return f(x);\n  /* e */\n  int[] g();\n}\n", [4, 7, 14]),
    "csharp": ("class A\n{\n  /// <summary>a</summary>\n  [Obsolete]\n  internal static int F(\n    int a)\n  {\n  }\n  // b\n  public int P { get; }\n  // c\n  int G() => 1;\n}\n", [5, 12]),
    "go": ("package a\n\n// F is.\nfunc F() {}\n\n// M does\n// more.\nfunc (t *T) M(a int) error {}\n\n// x\nvar y = 1\n\nvar s = `\n// no\nfunc z() {}\n`\n", [4, 8]),
    "rust": ("/// a\n#[inline]\npub fn f<'a>(x: &'a str) -> u8 {}\n\n/* b /* c */ */\nfn g() {}\n// d\nstruct S;\n", [3, 6]),
    "c": ("/* a */\nstatic const char *f(const char *x, int n) {\n}\n// b\nint g(void);\n/* c */\nlong\nh(\n  int a\n) {\n}\n", [2, 7 + 1]),
}


@pytest.mark.parametrize("language", sorted(DOCUMENTED))
def test_documented_functions_by_language(language):
    text, expected = DOCUMENTED[language]
    found = [line_at(line_of(text), name[0]) for _, _, name in pairs(text, language)]
    assert found == expected
    for crlf in (text.replace("\n", "\r\n"),):
        assert [line_at(line_of(crlf), name[0]) for _, _, name in pairs(crlf, language)][: len(expected)] == expected
