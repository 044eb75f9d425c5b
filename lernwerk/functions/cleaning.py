"""Column expressions that clean page and question texts: noise, footers, spacing, inline assembly, LaTeX."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Fixed value: page counters at the foot of a page. Patterns that name a publisher are the caller's to add.
NOISE = [r"·?\s*第\s*\d+\s*页[，,]\s*共\s*\d+\s*页\s*·?"]
# Chapter headings, and short lines of words only.
CHAPTER_LINE = r"^(第\s*\d+\s*章\s*.+|\d+\.\d+\s*.+)$"
SHORT_LINE = r"(?U)^[\x{4e00}-\x{9fff}\w\s/·]+$"

# Instructions of x86.
X86 = """push pop mov movzx movsx lea add adc sub sbb imul mul idiv div inc dec neg not and or xor test shl shr sar sal rol ror
cmp jmp je jne jz jnz jle jge jl jg ja jae jb jbe jc jnc jo jno js jns call ret nop int cdq cwd cbw cwde cdqe xchg bswap movabs
cmovz cmovnz cmovl cmovg cmovle cmovge setz setnz setl setg setle setge""".split()
# Instructions of RISC-V.
RISCV = """add addi sub and andi or ori xor xori sll slli srl srli sra srai slt slti sltu sltiu lw lh lhu lb lbu sw sh sb
beq bne blt bge bltu bgeu j jal jalr lui auipc ecall ebreak fence mul mulh div divu rem remu""".split()
# Instructions that are common words, so not marked within prose.
WORDS = {"int", "and", "or", "not"}

INLINE_ASM = rf"(?iU)(?<!`)\b({'|'.join(x for x in X86 if x not in WORDS)})\b(?!`)"
ASM_LINE = rf"(?iU)^(\d+\s+[0-9a-f]+\s+)?({'|'.join(sorted({*X86, *RISCV}))})\b"

# LaTeX commands within table cells and what they read as.
LATEX = {r"\rightarrow": "->", r"\leftarrow": "<-", r"\times": "*", r"\cdots": "...", r"\cdot": "*", r"\div": "/", r"\leq": "<=", r"\geq": ">=", r"\neq": "!=", r"\sim": "~", r"\qquad": " ", r"\lambda": "lambda", r"\Lambda": "Lambda", r"\partial": "partial", r"\ast": "*", r"\flat": "b"}


def page_noise(c: str | Column, patterns: list[str] | None = None) -> Column:
    """Without the noise patterns and the white space that they take in, newlines too; at most one blank line in sequence; stripped. Null stays null."""
    out = reduce(lambda x, p: F.regexp_replace(x, p, ""), NOISE if patterns is None else patterns, T.col(c))
    return T.strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def footer_lines(c: str | Column, patterns: list[str] | None = None, most: int = 10, short: int = 15) -> Column:
    """Without the blank, noisy and chapter lines that end a text, up to ``most`` of them.

    A short line of words goes only when a line below it went. Blank lines at the end always go. Null stays null.
    """
    noise = "|".join(f"(?:{p})" for p in (NOISE if patterns is None else patterns)) or "(?!)"

    def goes(line: Column, below: Column) -> Column:
        return (line == "") | F.regexp_like(line, F.lit(noise)) | F.regexp_like(line, F.lit(CHAPTER_LINE)) | ((below > 0) & (F.length(line) <= short) & F.regexp_like(line, F.lit(SHORT_LINE)))

    state = lambda n, is_open: F.struct(n.alias("n"), F.lit(is_open).alias("open"))
    step = lambda s, x: F.when(s["open"] & goes(x, s["n"]), state(s["n"] + 1, True)).otherwise(state(s["n"], False))
    tail = lambda lines: F.transform(F.slice(F.reverse(lines), 1, most), T.strip)
    cut = lambda lines: F.aggregate(tail(lines), state(F.lit(0), True), step, lambda s: s["n"])
    kept = T.once(F.split(T.col(c), "\n", -1), lambda lines: F.array_join(F.slice(lines, F.lit(1), F.size(lines) - cut(lines)), "\n"))
    return T.once(kept, lambda k: F.when(T.strip(k) == "", "").otherwise(F.regexp_replace(k, r"(?U)\n\s*\z", "")))


def part_spacing(c: str | Column) -> Column:
    """Two blank lines before the lines that begin with a part number in brackets."""
    return F.regexp_replace(T.col(c), r"\n([（(][1-9]\d*[）)])", "\n\n\n$1")


def mark_inline_asm(c: str | Column) -> Column:
    """Instructions in back-ticks outside code fences. A fence without an end is none."""
    mark = lambda x: F.regexp_replace(x, INLINE_ASM, "`$1`")
    fence = F.lit("```")
    piece = lambda x, i, parts, n: (
        F.when((i % 2 == 1) & (i < n - 1), F.concat(fence, x, fence))
        .when(i % 2 == 1, "")
        .when(i == n - 2, mark(F.concat(x, fence, F.element_at(parts, -1))))
        .otherwise(mark(x))
    )
    split = T.once(F.split(T.col(c), "```", -1), lambda p: F.struct(p.alias("parts"), F.size(p).alias("n")))
    return T.once(split, lambda s: F.array_join(F.transform(s["parts"], lambda x, i: piece(x, i, s["parts"], s["n"])), ""))


def latex_text(c: str | Column) -> Column:
    """Readable text of a cell in LaTeX: known commands become signs, others go, groups lose their braces."""
    out = F.regexp_replace(T.col(c), r"\\(?:mathrm|mathord|mathbb|operatorname|mathsf|cal)\s*\{+([^{}]*)\}+", "$1")
    for command, sign in LATEX.items():
        out = F.replace(out, F.lit(command), F.lit(sign))
    out = F.regexp_replace(F.regexp_replace(out, r"\\(?:left|right)\s*", ""), r"\\[A-Za-z]+", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"[{}\\]", " "), r"(?U)\s+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"\(\s+", "("), r"\s+\)", ")"), r"^[ ,;]+|[ ,;]+$", "")


def array_blocks(c: str | Column) -> Column:
    """The bodies of LaTeX arrays."""
    return F.regexp_extract_all(T.col(c), F.lit(r"(?s)\\begin\{array\}\s*\{[^}]*\}(.*?)\\end\{array\}"), F.lit(1))
