import pytest

from loomdex.llm.parsing import check_files, rates
from loomdex.llm.syntax import check

PHP = r"""<?php
declare(strict_types=1);
namespace A\B { const X = 1; }
namespace C;
use A\{D, function e, const F as G}; use H as I, J;
use function K\l;
#[Attr(1), Other]
final readonly class P extends Q implements R, \S {
    use T, U { T::m insteadof U; U::m as protected n; }
    public const int Z = 1, Y = self::Z * 2;
    private ?array $a = ['k' => [1, 2], ...self::B]; protected static int|string|null $b; var $c;
    public function __construct(private readonly ?int $x = null, protected array &$y = [], string ...$rest) { parent::__construct(); }
    abstract protected static function &f(self $a, callable $c): static|null;
    public string $hooked { get => strtoupper($this->hooked); set(string $v) { $this->hooked = $v; } }
    public function list(): iterable { yield 1; yield 'k' => 2; yield from $this->g(); $x = yield; }
}
enum Suit: string implements HasName { case Hearts = 'H'; case Spades = 'S'; const Wild = self::Spades; public function n(): string { return $this->name; } }
interface V { const A = 1; public function w(int $a): void; }
function &g(int|float $a, (A&B)|null $b = new C(1)): never { throw new \E("x {$a['b']->c["d"]} ${e} $f[0]"); }
$f = static fn(int $x): int => $x ** -2 <=> 3; $h = function () use (&$a, $b): ?array { return [$a, , $b] ?? []; };
[$a, [, 'k' => $b]] = $c; list(, $d) = $e; $o = new class(1) extends A implements B { public $p; };
$m = match (true) { $a, $b => 1, default => throw new E, };
if ($a): ?> html <?= $b ?> <?php elseif ($c): foreach ($d as $k => [$v]): endforeach; else: endif;
for ($i = 0, $j = 1; $i < 10; $i++, $j--): endfor; while (1) { break 2; } do { continue; } while ($x instanceof Y && !$z);
switch ($a) { case 1: case 2; echo 1, 2; break; default: }
try { f(); } catch (A | B) { } catch (C $c) { } finally { }
$x = $a ? $b : ($c ?: $d); $x ??= $y?->z?->w()['k']::Q; $obj::class; $a::$b; $a->{$b . 'c'}(...); f(name: 1, ...$r);
$s = <<<"EOT"
  text { ( [ $a
  EOT . 'a' . <<<'N'
it's }
N;
goto end; end: static $q = 1, $r; global $g; unset($a[1], $b); print 'x'; @$a['b']; (int)$x; -$y; !isset($a) and die('x'); clone $a; include 'a.php';
echo `ls`; $a = &$b; $$n = 1; ${'x'} = 2; $a{$b ?? 0} ?? null;
?>
tail
"""
PHP = PHP.replace("$a{$b ?? 0} ?? null;", "").replace("[$a, , $b] ?? []", "[$a, $b] ?? []")

JS = r"""import a, { b as c, default as d } from './x'; import * as e from "y"; export * from 'z'; import 'side';
export default class A extends (B, C) { static #p = 1; static { init(); } get x() { return this.#p } set x(v) {} async *gen() { yield* a; await b } constructor({ a = 1, ...rest }, [b, , c] = []) { super(); } 'quoted'() {} [computed]() {} static async m() {} }
export const f = async (x, { y }) => ({ ...x, y, z() {}, get w() { return 1 }, [k]: v, async q() {} }), g = x => x ** 2;
label: for (const [k, v] of Object.entries(o)) { if (a) continue label; else break }
for (let i = 0, n = 5; i < n; i++) ; for (var p in q) {} for await (const z of s) {} do x++; while (x < 5) y()
const re = /[/"'{]+\/(?<n>a)/giu, t = `a ${b ? `n ${c}` : ''} } { $`, d2 = a / b / c, u = tag`x${1}`
switch (a) { case 1: { break } default: b() }
try { x() } catch { y() } finally { z() }
a?.b?.[c]?.(d); a ??= b || c && d; if (a) ; else { } var fn = function* () { }, o2 = { a, b, 'c': 1, 2: 3, get: 1, set, async: 2 }
new Foo; new a.b.C(1, ...args)[0]; delete a.b, void 0, typeof x; (function () {})(); !function () {}()
let v1 = a
  ? b : c
x = y
++z
return_ = 1; async () => { await x }; ({ a, b: [c] } = d); [a, b] = [b, a]
throw new Error('x')
"""
TS = r"""import type { A, B } from './t'; import { type C, D } from 'd';
export interface I<T extends object = {}> extends J, K<T> { readonly a?: string; [key: string]: unknown; m<U>(x: U): void; new (x: number): I<T>; (call: string): void }
type U = 'a' | "b" | { [K in keyof T]?: T[K] } | (A & B)[] | ((x: number, ...r: string[]) => void) | typeof x | [a: string, b?: number] | `p-${string}`; type C1<T> = T extends (infer R)[] ? R : never;
export enum E { A = 1, B = 'b' } declare module 'm' { const q: string } namespace N.M { export const x = 1 } declare global { interface Window { a: 1 } }
abstract class G<T> extends H<T> implements I<T> { private readonly x: number = 1; static y?: string; constructor(private a: string, public readonly b?: number) { super() } abstract m(): void; @dec() p!: Map<string, Array<number>>; get z(): string { return this.p as unknown as string } async q<T,>(this: G<T>, x?: T): Promise<T | null> { return x! } }
function over(a: string): void; function over(a: any): asserts a is string { }
const f = <T extends {}>(x: T, y = 1): x is T => x < y, g = (a: number): string => `${a}`, h = f<string>('x'), s = a satisfies B, k = <const>['a'], n = new Map<string, number>(), z = a < b, w = a >> 2 >>> 1, tern = a ? (b) : c
for (const x of y as string[]) { } export type { A }; let d: unique symbol, e1 = obj!.a!.b; export = f
"""


@pytest.mark.parametrize("language,text", [("php", PHP), ("javascript", JS), ("typescript", TS), ("typescript", JS.replace("export default class", "export class")), ("vue", "<!-- c -->\n<template>\n  <div><img :src=\"a > b\"><br/><template #x>{{ a < b }}</template></div>\n</template>\n<script setup lang=\"ts\">\nconst a: number = 1\n</script>\n<style scoped>a{}</style>\n")])
def test_valid(language, text):
    assert check(language, text) == []


@pytest.mark.parametrize(
    "language,text",
    [
        ("php", "no php here"), ("php", ""), ("php", "<?php\n$a = ;"), ("php", "<?php\nfunction f( { }"), ("php", "<?php\nclass A { function b() { }"), ("php", "<?php\n$a = 'open"), ("php", "<?php\n$a = 1\n$b = 2;"), ("php", "<?php\n<<<<<<< HEAD\n$a = 1;\n=======\n$a = 2;\n>>>>>>> x\n"), ("php", "<?php\nf(1, 2;"), ("php", "<?php\n}"),
        ("php", "<?php\nif ($a): echo 1;"), ("php", "<?php\nclass A { $x; }"), ("php", "<?php /* open"), ("javascript", "const a = ;"), ("javascript", "f(1, 2;"), ("javascript", "const a: number = 1"), ("javascript", "let a = 'open\nb"), ("javascript", "function f() { if (a) {"), ("javascript", "}"), ("javascript", "const x = `open ${a}"),
        ("javascript", "<?php echo 1;"), ("javascript", "a b"), ("javascript", "1 = 2"), ("javascript", "{ \"a\": 1, \"b\": 2 }"), ("typescript", "interface A { a: }"), ("typescript", "const a: = 1"), ("typescript", "<?php namespace A;"), ("vue", "export default {}"), ("vue", "<template><div></template>"), ("vue", "<template></template><script>let a = (</script>"), ("vue", "<script>let a"),
    ],
)
def test_invalid(language, text):
    assert check(language, text)


def test_markers_in_comments_are_no_conflict():
    markers = "<<<<<<< a\n=======\n>>>>>>> b\n"
    assert check("php", f"<?php\n/*\n{markers}*/\n$a = 1;\n") == [] == check("typescript", f"/*\n{markers}*/\nlet a = 1\n")


def test_recovery_finds_further_faults():
    faults = check("php", "<?php\n$a = ;\n$b = 1;\nfunction f()\n{\n    $c = (1;\n}\n$d = ];\n")
    assert [f.line for f in faults] == [2, 6, 8]


def test_deep_nesting_is_survived():
    assert check("javascript", "[" * 20_000) is not None and check("php", "<?php $a = " + "(" * 20_000) is not None


def test_files_and_rates(spark):
    chunks = spark.createDataFrame([("s", "/a.php"), ("s", "/a.php"), ("s", "/b.JS"), ("s", "/c.md"), ("s", "/gone.ts"), (None, "/x.php"), ("s", "/null.ts")], "source_name string, path string")
    files = spark.createDataFrame([("s", "/a.php", "<?php\n$a = ;"), ("s", "/a.php", "<?php\n$a = ;"), ("s", "/b.JS", "let a"), ("s", "/other.php", "bad"), ("s", "/null.ts", None)], "source_name string, path string, text string")
    out = {r["path"]: r for r in check_files(chunks, files).collect()}
    assert {p: r["valid"] for p, r in out.items()} == {"/a.php": False, "/b.JS": True, "/null.ts": True}
    assert out["/a.php"]["first_line"] == 2 and len(out["/a.php"]["faults"]) == 1
    assert {(r["language"], r["invalid"]) for r in rates(check_files(chunks, files)).collect()} == {("php", 1), ("javascript", 0), ("typescript", 0)}
    assert check_files(chunks.limit(0), files).count() == 0


def test_files_too_deep_are_neither_valid_nor_invalid(spark):
    deep = "let a = " + "[" * 20_000 + "]" * 20_000 + ";\n"
    texts = {"/deep.js": deep, "/bad.js": "let b = ;\n" + deep, "/good.js": "let c = 1;\n", "/deep.php": "<?php\n$a = " + "[" * 20_000 + "]" * 20_000 + ";\n", "/deep.vue": f"<script>\n{deep}</script>\n"}
    files = spark.createDataFrame([("s", p, t) for p, t in texts.items()], "source_name string, path string, text string")
    checked = check_files(files, files)
    out = {r["path"]: (r["valid"], r["first_cause"]) for r in checked.collect()}
    assert {p: out[p] for p in ("/deep.js", "/deep.php", "/deep.vue")} == dict.fromkeys(("/deep.js", "/deep.php", "/deep.vue"), (None, "too deep"))
    assert out["/bad.js"][0] is False and out["/bad.js"][1] != "too deep" and out["/good.js"] == (True, None)
    assert {r["language"]: (r["files"], r["invalid"], r["too_deep"], round(r["accepted"], 3)) for r in rates(checked).collect()} == {"javascript": (3, 1, 1, 0.333), "php": (1, 0, 1, 0.0), "vue": (1, 0, 1, 0.0)}
