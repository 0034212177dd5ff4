"""Code context of random files against its rules in plain loops."""

import random
import re

from errorlens.operators import context as X

LINES = ["import a.B;", "  import static a.C.*;", "class A {", "public class B", "interface C { }", "{", "}", "}}", "{{", "",
         "  void run() {", "int go(int a)", "private String name;", "  int k = 3;", "x = \"}\";", "} else {", "class A { int q; }"]


def expected(lines, L, n):
    """The fields of a context by their rules, forwards and backwards over the lines."""
    p, total = [0], 0
    for t in lines:
        total += t.count("}") - t.count("{")
        p.append(total)
    size = len(lines)
    is_class = [re.match(X.CLASS_RE, t) for t in lines]
    back = [i for i in range(L, 0, -1) if is_class[i - 1]]
    cname = is_class[back[0] - 1][3] if back else None
    out = {"class_name": cname, "method_name": None, "method_start": None, "method_end": None, "method_body": None}

    def end_of(i, level):
        opened = False
        for j in range(i, size + 1):
            opened = opened or "{" in lines[j - 1]
            if opened and p[j] == level:
                return j
        return size
    for i in range(L, 0, -1):
        m = re.match(X.METHOD_RE, lines[i - 1])
        if m and p[i - 1] >= p[L]:
            end = end_of(i, p[i - 1])
            out |= {"method_name": m[4], "method_start": i, "method_end": end,
                    "method_body": "".join(t + "\n" for t in lines[i - 1:end])}
            break
    out["surrounding_lines"] = lines[max(1, L - n) - 1:min(size, L + n)]
    first = next((i for i in range(1, size + 1) if is_class[i - 1]), size)
    out["imports"] = [t.strip() for t in lines[:first] if re.match(X.IMPORT_RE.replace(r"\z", r"\Z"), t)]
    fields = []
    if cname is not None:
        f = next(i for i in range(1, size + 1) if is_class[i - 1] and is_class[i - 1][3] == cname)
        for j in range(f, size + 1):
            if re.match(X.FIELD_RE, lines[j - 1]) and p[f - 1] - p[j] == 1:
                fields.append(lines[j - 1].strip())
            if p[j] == p[f - 1]:
                break
    out["class_fields"] = fields
    return out


def test_random_files(spark):
    rng = random.Random(4)
    files = {f"p/F{k}.java": [rng.choice(LINES) for _ in range(rng.randint(1, 40))] for k in range(25)}
    sources = spark.createDataFrame([(0, path, path[2:], "\n".join(t) + "\n") for path, t in files.items()],
                                    "root_rank int, rel_path string, file_name string, content string")
    asked = [(f"{path}:{L}:{c}", f"p.{path[2:-5]}", path[2:], L) for path, t in files.items()
             for L in {rng.randint(1, len(t)) for _ in range(6)} for c in "ab"]  # two clusters on each line
    gone = [("beyond", "p.F0", "F0.java", 99), ("zero", "p.F0", "F0.java", 0), ("none", "p.F0", "F0.java", None), ("else", "q.Z", "Z.java", 1)]
    clusters = spark.createDataFrame(asked + gone, "fingerprint string, primary_class string, primary_file string, primary_line int")
    got = {r.fingerprint: r for r in X.code_context(clusters, sources, n=3).collect()}
    assert set(got) == {a[0] for a in asked}
    for name, r in got.items():
        path, L, _ = name.split(":")
        # lines at the end of a text that are empty belong to the final line break
        for key, value in expected(files[path], int(L), 3).items():
            assert r[key] == value, (name, key)
