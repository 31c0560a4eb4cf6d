from skeingraph.sources.extract import observe


def facts(path, text):
    """(kind, name, fqname or target) of a file's observations after its file and module rows."""
    rows = observe(path, text.encode(), "r")
    assert [r["kind"] for r in rows[:2]] == ["file", "module"]
    return [(r["kind"], r["fqname"], r.get("target")) for r in rows[2:]]


def test_python():
    got = facts(
        "pkg/mod.py",
        "import os.path as osp, sys\nfrom . import helper\nfrom ..up import x as y\nclass A(Base, m.Other[int]):\n    '''doc'''\n    async def f(self, a, *b, c=g(), **d):\n        self.h()(1)\n        def inner(): pass\ny().z[0].w()\n",
    )
    assert got == [
        ("import", "pkg.mod", "os.path"), ("import", "pkg.mod", "sys"), ("import", "pkg.mod", "pkg.helper"), ("import", "pkg.mod", "up.x"), ("class", "pkg.mod.A", None), ("inherit", "pkg.mod.A", "Base"), ("inherit", "pkg.mod.A", "m.Other"),
        ("method", "pkg.mod.A.f", None), ("call", "pkg.mod.A.f", "g"), ("call", "pkg.mod.A.f", "self.h"), ("call", "pkg.mod.A.f", "self.h"), ("function", "pkg.mod.A.f.inner", None), ("call", "pkg.mod", "y.z.w"), ("call", "pkg.mod", "y"),
    ]
    row = observe("p.py", b"async def f(a, /, b, *c, d, **e): pass", "r")[2]
    assert row["signature"] == "async f(a, b, *c, d, **e)" and row["raw"]["parser"] == "python_ast"
    assert facts("a/__init__.py", "from .b import c")[0] == ("import", "a", "a.b.c")
    assert [k for k, _, _ in facts("bad.py", "def f(:\n")] == ["parse_error"]
    assert observe("empty.py", b"", "r")[1]["fqname"] == "empty" and facts("latin.py", "# -*- coding: nope -*-\nf()") in ([("call", "latin", "f")], [("parse_error", "latin:SyntaxError", None)])


def test_javascript():
    got = facts(
        "web/app.js",
        "import def, { one, two as deux } from './lib/util.js';\nimport * as ns from \"../shared\";\nimport './side.css';\nconst fs = require('fs');\nclass Cart extends Base {\n  static async total(x) { return one(x).then(y => deux(y)); }\n  #p = make();\n  get size() { return this.count(); }\n}\n"
        "const go = async (a) => { ns.run(`t ${inner(a)}`); };\nfunction* gen() { yield new Thing(1).start(); }\nexport default function main() { if (a / b) go(/re\\/(/.test('x')) }\nfoo?.bar();\n",
    )
    assert got == [
        ("import", "web.app", "web.lib.util"), ("import", "web.app", "web.lib.util.one"), ("import", "web.app", "web.lib.util.two"), ("import", "web.app", "web.lib.util.def"), ("import", "web.app", "shared"), ("import", "web.app", "shared"), ("import", "web.app", "web.side"),
        ("import", "web.app", "fs"), ("class", "web.app.Cart", None), ("inherit", "web.app.Cart", "Base"), ("method", "web.app.Cart.total", None), ("call", "web.app.Cart.total", "one(x).then"), ("call", "web.app.Cart.total", "one"), ("call", "web.app.Cart.total", "deux"),
        ("call", "web.app.Cart", "make"), ("method", "web.app.Cart.size", None), ("call", "web.app.Cart.size", "this.count"), ("function", "web.app.go", None), ("call", "web.app.go", "ns.run"), ("call", "web.app.go", "inner"), ("function", "web.app.gen", None),
        ("call", "web.app.gen", "new Thing(1).start"), ("call", "web.app.gen", "Thing"), ("function", "web.app.main", None), ("call", "web.app.main", "go"), ("call", "web.app.main", "/re\\/(/.test"), ("call", "web.app", "foo?.bar"),
    ]
    assert [k for k, _, _ in facts("x.js", "function f( {")] == ["parse_error"]


def test_typescript_and_tsx():
    got = facts(
        "src/index.ts",
        "import type { T } from './types';\nimport { verify as check } from './pay';\nexport interface Shape { area(x: number): number }\ntype Fn = (a: string) => void;\nexport class Box<T> extends Base implements Shape, Other<T> {\n  private x: number = init();\n  constructor(private a: string) { super(a); }\n  area(n: number): number { return check<T>(n); }\n  abstract later(): void;\n}\nfunction over(a: string): void;\nfunction over(a: any): void { a!.b(); }\n",
    )
    assert got[:10] == [
        ("import", "src", "src.types"), ("import", "src", "src.types.T"), ("import", "src", "src.pay"), ("import", "src", "src.pay.verify"), ("interface", "src.Shape", None), ("interface", "src.Fn", None), ("class", "src.Box", None),
        ("inherit", "src.Box", "Base"), ("inherit", "src.Box", "Shape"), ("inherit", "src.Box", "Other<T>"),
    ]
    kinds = [(k, f, t) for k, f, t in got if k in ("method", "call", "function")]
    assert kinds == [("call", "src.Box", "init"), ("method", "src.Box.constructor", None), ("call", "src.Box.constructor", "super"), ("method", "src.Box.area", None), ("call", "src.Box.area", "check"), ("function", "src.over", None), ("call", "src.over", "a!.b")]
    tsx = facts("ui/view.tsx", "export const View = () => <div onClick={() => save('x')}>it's {label()} <b/></div>;\nfunction after() { done(); }\n")
    assert tsx == [("function", "ui.view.View", None), ("call", "ui.view.View", "save"), ("call", "ui.view.View", "label"), ("function", "ui.view.after", None), ("call", "ui.view.after", "done")]


def test_java():
    got = facts(
        "src/shop/Pay.java",
        "package com.shop;\nimport java.util.List;\nimport static a.B.go;\n@Deprecated(since=\"x\")\npublic class Pay extends Base implements Run<String>, Other {\n  private int n = calc(1);\n  public Pay(int a) { super(a); this.n = a; }\n  <T> List<T> all(T t) throws E { return helper.find(t).list(); }\n  void make() { Thing th = new Thing<String>(one()); Runnable r = () -> go(); }\n  interface In { void m(); }\n  enum Color { RED(first()), BLUE; void e() { x(); } }\n}\nrecord Point(int x) implements In { }\n",
    )
    assert got == [
        ("import", "com.shop.Pay$module", "java.util.List"), ("import", "com.shop.Pay$module", "a.B.go"), ("class", "com.shop.Pay", None), ("inherit", "com.shop.Pay", "Base"), ("inherit", "com.shop.Pay", "Run<String>"), ("inherit", "com.shop.Pay", "Other"),
        ("call", "com.shop.Pay", "calc"), ("method", "com.shop.Pay.Pay", None), ("method", "com.shop.Pay.all", None), ("call", "com.shop.Pay.all", "helper.find(t).list"), ("call", "com.shop.Pay.all", "helper.find"), ("method", "com.shop.Pay.make", None),
        ("call", "com.shop.Pay.make", "Thing<String>"), ("call", "com.shop.Pay.make", "one"), ("call", "com.shop.Pay.make", "go"), ("interface", "com.shop.Pay.In", None), ("method", "com.shop.Pay.In.m", None), ("enum", "com.shop.Pay.Color", None),
        ("call", "com.shop.Pay.Color", "first"), ("method", "com.shop.Pay.Color.e", None), ("call", "com.shop.Pay.Color.e", "x"), ("record", "com.shop.Point", None), ("inherit", "com.shop.Point", "In"),
    ]


def test_go():
    got = facts(
        "svc/run.go",
        'package svc\nimport (\n  "fmt"\n  p "a/b/pay"\n)\ntype Proc struct { n int }\ntype Doer interface { Do(x int) error }\nfunc (r *Proc) Verify(x int) (ok bool, err error) {\n  defer r.close()\n  go func() { fmt.Println(p.Pay(x)) }()\n  y := []byte("s")\n  return check(x, y), nil\n}\nfunc check(a int, b interface{}) bool { return a > 0 }\n',
    )
    assert got == [
        ("import", "svc.run", "fmt"), ("import", "svc.run", "a.b.pay"), ("struct", "svc.run.Proc", None), ("interface", "svc.run.Doer", None), ("method", "svc.run.Proc.Verify", None), ("call", "svc.run.Proc.Verify", "r.close"),
        ("call", "svc.run.Proc.Verify", "fmt.Println"), ("call", "svc.run.Proc.Verify", "p.Pay"), ("call", "svc.run.Proc.Verify", "check"), ("function", "svc.run.check", None),
    ]


def test_rust():
    got = facts(
        "app/src/main.rs",
        "use crate::net::Client;\nuse std::fmt;\npub trait Run { fn go(&self); fn twice(&self) { self.go(); } }\n#[derive(Debug)]\npub struct Job<'a> { name: &'a str }\nenum E { A(i32), B }\nimpl<'a> Run for Job<'a> {\n  fn go(&self) { println!(\"x {}\", 1); Client::open(self.name).unwrap(); }\n}\nfn main() { let Some(x) = get() else { return }; match x { E::A(n) => use_it(n), E::B => {} } }\n",
    )
    assert got == [
        ("import", "app.src.main", "app.src.net.Client"), ("import", "app.src.main", "std.fmt"), ("trait", "app.src.main.Run", None), ("method", "app.src.main.Run.go", None), ("method", "app.src.main.Run.twice", None), ("call", "app.src.main.Run.twice", "self.go"),
        ("struct", "app.src.main.Job", None), ("enum", "app.src.main.E", None), ("inherit", "app.src.main.Job<'a>", "Run"), ("method", "app.src.main.Job<'a>.go", None), ("call", "app.src.main.Job<'a>.go", "println"),
        ("call", "app.src.main.Job<'a>.go", "Client.open(self.name).unwrap"), ("call", "app.src.main.Job<'a>.go", "Client.open"), ("function", "app.src.main.main", None), ("call", "app.src.main.main", "get"), ("call", "app.src.main.main", "use_it"),
    ]


def test_c_and_cpp():
    got = facts("lib/ops.c", '#include "./util.h"\n#include <stdio.h>\n#define X(a) \\\n  b(a)\nstruct point { int x; };\nint helper(int a);\nstatic int *run(struct point *p) {\n  if (p->x) return fused(p->get(1));\n  return helper(2);\n}\n')
    assert got == [("import", "lib.ops", "lib.util"), ("struct", "lib.ops.point", None), ("function", "lib.ops.run", None), ("call", "lib.ops.run", "fused"), ("call", "lib.ops.run", "p->get"), ("call", "lib.ops.run", "helper")]
    got = facts(
        "lib/eng.cpp",
        'namespace core {\nclass Base { public: virtual ~Base() = default; int base() { return one(); } };\ntemplate <class T> class Eng final : public Base, ns::Mix { Eng(int a) : x(a) { init(); } void go(); };\nenum class Mode { A, B };\nvoid Eng::go() { auto p = new Part(1); std::sort(a, b); Foo f(2); this->base(); }\nbool operator==(A a, A b) { return eq(a, b); }\n}\n',
    )
    assert got == [
        ("class", "lib.eng.core.Base", None), ("function", "lib.eng.core.Base.~Base", None), ("function", "lib.eng.core.Base.base", None), ("call", "lib.eng.core.Base.base", "one"), ("class", "lib.eng.core.Eng", None), ("inherit", "lib.eng.core.Eng", "Base"),
        ("inherit", "lib.eng.core.Eng", "Mix"), ("function", "lib.eng.core.Eng.Eng", None), ("call", "lib.eng.core.Eng.Eng", "init"), ("enum", "lib.eng.core.Mode", None), ("method", "lib.eng.core.Eng.go", None), ("call", "lib.eng.core.Eng.go", "Part"),
        ("call", "lib.eng.core.Eng.go", "std.sort"), ("call", "lib.eng.core.Eng.go", "this->base"), ("function", "lib.eng.core.operator==", None), ("call", "lib.eng.core.operator==", "eq"),
    ]


def test_bash_and_css():
    got = facts("bin/run.sh", '#!/bin/bash\nsource ./lib.sh\nX=1\nbuild() {\n  local y=$(now -u)\n  if [ -z "$y" ]; then helper "$1" | grep x; fi\n  for f in a b; do copy "$f" && done_with; done\n}\nfunction other {\n  echo "it\'s $(inner)"\n}\ncase "$1" in\n  start) build ;;\nesac\n')
    assert got == [
        ("import", "bin.run", "bin.lib"), ("function", "bin.run.build", None), ("call", "bin.run.build", "now"), ("call", "bin.run.build", "helper"), ("call", "bin.run.build", "grep"), ("call", "bin.run.build", "copy"), ("call", "bin.run.build", "done_with"),
        ("function", "bin.run.other", None), ("call", "bin.run.other", "echo"), ("call", "bin.run.other", "inner"), ("call", "bin.run", "build"),
    ]
    got = facts("web/a.css", '@import "./base.css";\n/* x { */ .card:hover > a, #id[data-x="}"] { color: red; }\n@media (min-width: 1px) { .wide, p:is(a, b) { x: url(a;b) } }\n@font-face { font: x }\n')
    assert got == [("import", "web.a", "web.base"), ("selector", "web.a::.card:hover > a", None), ("selector", 'web.a::#id[data-x="}"]', None), ("selector", "web.a::.wide", None), ("selector", "web.a::p:is(a, b)", None)]
    assert [k for k, _, _ in facts("b.css", ".x { color: red;")] == ["parse_error"]


def test_spans_are_lines_and_utf8_columns():
    row = next(r for r in observe("a.js", "/* é */ ünï(1)\n".encode(), "r") if r["kind"] == "call")
    assert row["span"] == {"start_line": 1, "start_col": 9, "end_line": 1, "end_col": 17}


def test_large_file_and_odd_input():
    text = "".join(f"export function f{i}() {{ return f{i - 1}(); }}\n" for i in range(700))
    assert sum(k == "function" for k, _, _ in facts("big.ts", text)) == 700
    for ext in ("js", "ts", "tsx", "java", "go", "rs", "c", "cpp", "sh", "css", "py"):
        for text in ("", "\n\n", "((((", "}", '"', "class", "class {", "function", "import", "a.b.", "\0", "new", "fn", "impl", "type", "const x =", "struct", "enum", "é" * 10):
            rows = observe(f"x.{ext}", text.encode(), "r")
            assert [r["kind"] for r in rows[:2]] == ["file", "module"]
    assert observe("x.txt", b"a", "r") == []
