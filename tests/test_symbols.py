"""Definitions that look alike and aren't: each language's everyday forms."""

import pytest

from citespan.operators.extract.symbols import extract


def found(lang, source, *kinds):
    return [(name, kind, line) for name, kind, line, _ in extract(lang, source) if not kinds or kind in kinds]


def test_go_groups():
    source = "package p\n\ntype (\n\tA struct {\n\t\tx int\n\t}\n\tB int\n\tC = B\n\tD[T any] []T // note\n)\n\ntype E[T any] struct{}\ntype F [3]int\ntype G = int\ntype (H int; I func(a int) error)\n"
    assert found("go", source, "type") == [("A", "type", 4), ("B", "type", 7), ("D", "type", 9), ("E", "type", 12), ("F", "type", 13), ("H", "type", 15), ("I", "type", 15)]


def test_rust_signatures_and_macros():
    source = """trait T {
    fn wanted(&self) -> [u8; 3];
    fn given(&self) -> i32 { 1 }
}
extern "C" { fn c_side(x: i32); }
macro_rules! make {
    ($n:ident) => { fn inside() {} struct S; };
}
other! { fn hidden() {} }
fn real<F: Fn(i32) -> i32>(f: F, a: [u8; 2]) -> Option<i32> where F: Copy { vec![fn_ptr(1)]; None }
"""
    assert found("rust", source, "function", "struct", "macro", "trait") == [("T", "trait", 1), ("given", "function", 3), ("make", "macro", 6), ("real", "function", 10)]


def test_cpp_methods_in_classes():
    source = """class A : public B {
  int inside() const { return 1; }
  struct N { void deep() {} };
};
int A::outside() { return 2; }
int free_one(int x) {
  return x;
}
struct S { int y; };
static void last() {
}
"""
    assert found("cpp", source, "function", "method", "class", "struct") == [("A", "class", 1), ("N", "struct", 3), ("outside", "method", 5), ("free_one", "function", 6), ("S", "struct", 9), ("last", "function", 10)]


def test_typescript_overloads():
    source = """function f(a: string): void;
function f(a: number): void
function f(a: any): { b: number } {
  return { b: 1 };
}
export function g(x: string): x is "a";
export function g(x: any): boolean { return true }
declare function h(): void;
abstract class K {}
export abstract class L {}
class M {}
function n()
{
}
"""
    assert found("typescript", source, "function", "export", "class") == [("f", "function", 3), ("g", "export", 7), ("g", "function", 7), ("M", "class", 11), ("n", "function", 12)]


@pytest.mark.parametrize("source,names", [("def empty?\nend", ["empty?"]), ("def save!(x)\nend", ["save!"]), ("def name=(v)\nend", []), ("def self.build = 1", ["build"]), ("def ==(o)\nend", []), ("def Kernel\nend", []), ("def a; end; def b() end", ["a", "b"])])
def test_ruby_names(source, names):
    assert [n for n, _, _ in found("ruby", source, "method")] == names
