"""Rule table on a small labelled snippet (our own text)."""

from conftest import diff_frame

from reviewgrid.plans.review import chunk_diffs, rule_findings

SNIPPET = '''API_TOKEN = "abcdef123456"

def fetch(name):
    sql = "SELECT * FROM t WHERE n = '" + name + "'"
    cur.execute(sql)

def getAll(items=[]):
    for a in items:
        for b in items:
            for c in items:
                cur.execute(f"SELECT {a}")
    try:
        pass
    except:
        pass

class bad_name:
    pass
'''


def test_rules_by_line(spark):
    diff = "+++ b/s.py\n" + "".join("+" + line + "\n" for line in SNIPPET.split("\n")[:-1])
    found = rule_findings(chunk_diffs(diff_frame(spark, [diff])))
    hits = {(r.line_number, r.rule_id) for r in found.collect()}
    # module-level constants never reach a reviewer (not inside a chunk)
    assert not any(rule == "R3" for _, rule in hits)
    assert (4, "R1") in hits                       # concatenated SQL
    assert (7, "R13") in hits and (7, "R14") in hits and (7, "R16") in hits
    assert (8, "R9") in hits                       # query inside a loop
    assert (9, "R10") in hits and (10, "R10") in hits
    assert (11, "R2") in hits                      # f-string SQL
    assert (14, "R12") in hits                     # bare except
    assert (17, "R15") in hits                     # class name
    assert (3, "R18") in hits and (7, "R18") in hits
    sev = {(r.line_number, r.rule_id): r.severity for r in found.collect()}
    assert sev[(10, "R10")] == "high" and sev[(9, "R10")] == "medium"
