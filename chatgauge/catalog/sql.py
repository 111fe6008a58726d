"""SQL pieces the oracle texts share."""

# tokens are separated by these blanks
BLANK = "[ \\t\\r\\n]"
SOLID = "[^ \\t\\r\\n]"


def quoted(text):
    return "'" + text.replace("'", "''") + "'"


def rounded(x, digits):
    return f"CAST(printf('%.{digits}f', {x}) AS DOUBLE)"


def ratio(a, b):
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"


def label(text, classes, order):
    """Label of a text; ``order`` is the search order, written out by hand."""
    tests = " ".join(
        f"WHEN regexp_matches(upper({text}), '(^|[^\\p{{L}}\\p{{N}}_]){c}($|[^\\p{{L}}\\p{{N}}_])') THEN '{c}'"
        for c in order
    )
    return f"CASE WHEN {text} IS NULL THEN NULL {tests} ELSE '{classes[0]}' END"


def turn(role="role", text="text"):
    return f"'<|im_start|>' || {role} || chr(10) || {text} || '<|im_end|>'"


def first_tokens(text, n):
    more = f"regexp_matches({text}, '^{BLANK}*({SOLID}+{BLANK}+){{{n}}}{SOLID}')"
    cut = f"regexp_extract({text}, '^{BLANK}*({SOLID}+{BLANK}+){{{n - 1}}}{SOLID}+')"
    return more, f"CASE WHEN {more} THEN {cut} ELSE {text} END"


def class_table(scored, tasks):
    """CTEs: scored, spec, cls, per; tasks are (task, kind, gate, classes)."""
    spec = ", ".join(f"('{t}', '{k}', CAST({g} AS DOUBLE))" for t, k, g, _ in tasks)
    cls = ", ".join(f"('{t}', {i}, '{c}')" for t, _, _, cs in tasks for i, c in enumerate(cs))
    return f"""
WITH scored AS ({scored}),
spec(task, kind, gate) AS (VALUES {spec}),
cls(task, pos, label) AS (VALUES {cls}),
per AS (
  SELECT c.task, c.pos, c.label,
    count(*) FILTER (WHERE s.expected = c.label) AS samples,
    count(*) FILTER (WHERE s.expected = c.label AND s.predicted = c.label) AS tp,
    count(*) FILTER (WHERE s.expected <> c.label AND s.predicted = c.label) AS fp,
    count(*) FILTER (WHERE s.expected = c.label AND s.predicted IS DISTINCT FROM c.label) AS fn
  FROM cls c LEFT JOIN scored s ON s.task = c.task GROUP BY c.task, c.pos, c.label)"""


def per_class(scored, tasks):
    return class_table(scored, tasks) + f"""
SELECT per.task, label, pos, samples, tp AS correct, {ratio('tp', 'samples')} AS accuracy, tp, fp, fn
FROM per JOIN spec USING (task) WHERE kind = 'multiclass' OR samples > 0"""


def metric_table(scored, tasks):
    """Further CTEs ending in ``m``: the metrics of every task."""
    return class_table(scored, tasks) + f""",
pr AS (SELECT *, {ratio('tp', 'tp + fp')} AS p, {ratio('tp', 'tp + fn')} AS r FROM per),
f AS (SELECT *, {ratio('2 * p * r', 'p + r')} AS f1 FROM pr),
macro AS (
  SELECT task,
    list_reduce(list(p ORDER BY pos), lambda a, b: a + b) / count(*) AS p,
    list_reduce(list(r ORDER BY pos), lambda a, b: a + b) / count(*) AS r,
    list_reduce(list(f1 ORDER BY pos), lambda a, b: a + b) / count(*) AS f1
  FROM f GROUP BY task),
n AS (
  SELECT spec.task, count(s.task) AS total_samples, count(s.expected) AS evaluated,
    count(*) FILTER (WHERE s.expected = s.predicted) AS correct
  FROM spec LEFT JOIN scored s ON s.task = spec.task GROUP BY spec.task),
m0 AS (
  SELECT spec.task, kind AS task_type, n.total_samples, n.evaluated, n.correct,
    {ratio('n.correct', 'n.total_samples')} AS accuracy,
    CASE WHEN kind = 'binary' THEN f.p ELSE macro.p END AS "precision",
    CASE WHEN kind = 'binary' THEN f.r ELSE macro.r END AS recall,
    CASE WHEN kind = 'binary' THEN f.f1 ELSE macro.f1 END AS f1,
    CASE WHEN kind = 'binary' THEN f.tp END AS tp, CASE WHEN kind = 'binary' THEN f.fp END AS fp,
    CASE WHEN kind = 'binary' THEN f.fn END AS fn, gate AS quality_gate,
    CASE WHEN kind = 'binary' THEN n.evaluated - f.tp - f.fp - f.fn END AS tn
  FROM spec JOIN n USING (task) JOIN macro USING (task) JOIN f ON f.task = spec.task AND f.pos = 0),
m AS (SELECT *, {rounded('accuracy', 4)} >= quality_gate AS quality_gate_passed FROM m0)"""


def metrics(scored, tasks):
    return metric_table(scored, tasks) + "\nSELECT * FROM m"


def subword_counts(table, key, vocabulary, n):
    """Tokens of each text, whether they are more than n, and the bytes of the first n: byte pairs merged step by step."""
    return rf"""
WITH RECURSIVE ranks AS (
  SELECT hex(from_base64(b)) AS h, r
  FROM read_csv('{vocabulary}', delim = ' ', header = false, quote = '', columns = {{'b': 'VARCHAR', 'r': 'BIGINT'}})),
spaced AS (
  -- the last blank of a run belongs to what follows
  SELECT {key}, regexp_replace(text, '([ \t\n\r\f]+)([ \t\n\r\f][^ \t\n\r\f])', '\1' || chr(1) || '\2', 'g') AS t FROM {table}),
found AS (
  SELECT {key}, regexp_extract_all(t,
    '''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^ \t\n\r\f\x01\p{{L}}\p{{N}}]+|[ \t\n\r\f]+') AS ps FROM spaced),
pieces AS (SELECT {key}, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM found),
kinds AS (SELECT DISTINCT p, hex(encode(p)) AS hp FROM pieces),
merging AS (
  SELECT p, 0 AS step, i, substring(hp, 2 * i - 1, 2) AS h FROM (SELECT p, hp, unnest(range(1, len(hp) // 2 + 1)) AS i FROM kinds)
  UNION ALL
  SELECT p, step + 1, i, CASE WHEN i = best THEN h || nh ELSE h END
  FROM (
    SELECT m.*, first(CASE WHEN r.r IS NOT NULL THEN i END) OVER (PARTITION BY p ORDER BY r.r NULLS LAST, i) AS best
    FROM (
      SELECT *, lead(h) OVER places AS nh, lag(i) OVER places AS before FROM merging WINDOW places AS (PARTITION BY p ORDER BY i)) m
    LEFT JOIN ranks r ON r.h = m.h || m.nh)
  WHERE best IS NOT NULL AND before IS DISTINCT FROM best),
ended AS (SELECT p, max(step) AS step FROM merging GROUP BY p),
tokens AS (SELECT p, list(len(h) // 2 ORDER BY i) AS sizes FROM merging JOIN ended USING (p, step) GROUP BY p),
placed AS (
  SELECT {key}, size, row_number() OVER (PARTITION BY {key} ORDER BY k, j) AS place
  FROM (SELECT {key}, k, unnest(sizes) AS size, generate_subscripts(sizes, 1) AS j FROM pieces JOIN tokens USING (p))),
counted AS (SELECT {key}, count(*) AS n, sum(size) FILTER (WHERE place <= {n}) AS kept FROM placed GROUP BY {key})
SELECT {key}, CAST(coalesce(n, 0) AS BIGINT) AS n_tokens, coalesce(n, 0) > {n} AS truncated, CAST(coalesce(kept, 0) AS BIGINT) AS kept_bytes
FROM {table} LEFT JOIN counted USING ({key}) WHERE text IS NOT NULL"""
