"""Trees, references and chunks of laws made of whole documents, every row against plain versions."""

import os
import re

import pytest

from lexmill.functions import rules
from lexmill.operators import chunks, parse
from lexmill.plans import trees

SF = os.environ.get("LEXMILL_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
py = lambda pattern: re.compile(pattern.replace("(?iu)", "(?i)").replace("(?U)", "").replace("(?isu)", "(?is)").replace("(?iuU)", "(?i)"))
FORMS = [(k, py(p)) for k, p in parse.LINE_FORMS]
LABELS = parse.LABELS
ABOVE = {"phan": [], "phu_luc": [], "chuong": ["phan"], "muc": ["chuong"], "dieu": ["muc", "chuong", "phan"], "khoan": ["dieu"], "diem": ["khoan"], "tiet": ["diem"]}
NEEDS = {"muc", "khoan", "diem", "tiet"}


def kind_of(line):
    text = line.strip(" ")
    for kind, form in FORMS:
        m = form.match(text)
        if not m or (kind == "phu_luc" and re.search(r"(?i)kèm\s+theo", text)):
            continue
        if kind == "khoan" and (any(py(p).search(text) for p in parse.NO_CLAUSE) or len((re.match(r"^\d+\.\s*(.+)$", text) or [None, ""])[1]) < 4):
            continue
        return kind, m[1] or "", m[2]
    return "text", None, line


def clean(text):
    text = re.sub(r"(?is)[ \n\t,./]*Nơi\s+nhận\s*:.*", "", text)
    text = re.sub(r"(?s)[ \n\t,.:]*(?:HỘ,\s*CÁ\s+NHÂN\s+KINH|SỔ\s+DOANH\s+THU\s+BÁN\s+HÀNG).*", "", text)
    return re.sub("\n| {2,}", " ", text).strip(" ")


def plain_tree(doc, text):
    nodes, open_, in_form, twins = [], {}, False, {}
    for at, line in enumerate(text.split("\n")):
        if re.match(r"(?i)\s*Nơi\s+nhận\s*:", line):
            break
        if not line.strip(" "):
            continue
        kind, index, rest = kind_of(line)
        if py(parse.FORM_LINE).search(line.strip(" ")):
            in_form = True
        elif kind in ("dieu", "chuong", "muc", "phan"):
            in_form = False
        if in_form and kind in ("khoan", "diem", "tiet", "text"):
            continue
        if kind == "text":
            if open_:
                owner = max(open_.values(), key=lambda n: n["seq"])
                late = len(line) - len(line.lstrip(" ")) < {"diem": 3, "tiet": 6}.get(owner["kind"], 0)
                owner["late" if late else "lead"].append(rest)
            continue
        parent = next((open_[k] for k in ABOVE[kind] if k in open_), None)
        if kind in NEEDS and parent is None:
            continue
        for k in [k for k in open_ if parse.RANK[k] >= parse.RANK[kind]]:
            del open_[k]
        key = (parent["seq"] if parent else None, kind, index)
        twins[key] = twins.get(key, 0) + 1
        segment = "_".join(x for x in (kind, index, str(twins[key]) if twins[key] > 1 else "") if x)
        titled = kind in ("phan", "chuong", "muc", "phu_luc", "dieu")
        title = rest.strip(" ") or None if titled else None
        crumb = f"{LABELS[kind]} {index}".strip() + (f": {title}" if title else "")
        up = parent or {"id": f"doc_{doc}", "crumbs": [], "depth": -1}
        node = {"seq": at, "parent": parent, "kind": kind, "index": index, "title": title, "body": "" if titled else rest, "lead": [], "late": [], "kids": [], "id": f"{up['id']}_{segment}", "crumbs": [*up["crumbs"], crumb], "depth": up["depth"] + 1}
        if parent:
            parent["kids"].append(node)
        nodes.append(node)
        open_[kind] = node
    for n in nodes:
        n["lead"], n["late"] = "\n".join(n["lead"]), "\n".join(n["late"])
        if n["kind"] in ("chuong", "muc") and n["title"] is None and n["lead"]:
            n["title"], n["lead"] = re.sub(r"\s*\n\s*", " ", n["lead"]).strip(" "), ""
        elif n["kind"] == "dieu" and n["kids"] and n["lead"] and not n["lead"].rstrip(" ").endswith(":"):
            n["title"], n["lead"] = " ".join(x for x in (n["title"], re.sub(r"\s*\n\s*", " ", n["lead"]).strip(" ")) if x), ""
            for below in [n, *(x for x in nodes if x["seq"] > n["seq"] and len(x["crumbs"]) > n["depth"] and x["crumbs"][: n["depth"] + 1] == n["crumbs"])]:
                below["crumbs"] = [*below["crumbs"][: n["depth"]], f"Điều {n['index']}: {n['title']}", *below["crumbs"][n["depth"] + 1 :]]
        if not n["kids"]:
            content, lead = " ".join(x.strip(" ") for x in (n["body"], n["lead"], n["late"]) if x.strip(" ")), ""
            n["late"] = ""
        elif n["body"].strip(" ") and not re.search(r"[.?!:;]$", n["body"].strip(" ")):
            content, lead = "", " ".join(x for x in (n["body"], n["lead"].strip(" ")) if x)
        else:
            content, lead = n["body"], n["lead"]
        n["content"], n["lead"] = clean(content), clean(lead)
    return nodes


@pytest.fixture(scope="module")
def laws(spark):
    return {r.doc_id: plain_tree(r.doc_id, r.text) for r in trees._legal_texts(spark, SF).collect()}


def test_trees(spark, laws):
    want = sorted((d, n["seq"], n["id"], n["parent"]["seq"] if n["parent"] else None, n["depth"], n["kind"], n["index"], n["title"], n["content"], n["lead"], " > ".join(n["crumbs"])) for d, nodes in laws.items() for n in nodes)
    got = trees.parse_tree(spark, SF).select("doc_id", "seq", "node_id", "parent_seq", "depth", "kind", "index", "title", "content", "lead_in", "breadcrumb").collect()
    got = sorted(map(tuple, got), key=lambda x: x[:2])
    assert len(got) == len(want) > 1000
    for g, w in zip(got, want):
        assert g == w


def test_references(spark, laws):
    """Internal references by a plain scan; the external ones by the one decree that every article names."""
    internal, decree = re.compile(r"(?i)(?:điểm\s+([a-zđ])\s+)?(?:khoản\s+(\d+)\s+)?điều\s+(\d+)"), "Nghị định số 20/2026/NĐ-CP"
    want = set()
    for d, nodes in laws.items():
        article = {n["index"]: n["id"] for n in nodes if n["kind"] == "dieu"}  # the last one of a number
        for n in nodes:
            text = n["content"] + " " + n["lead"]
            for m in internal.finditer(text):
                base, rest = article.get(m[3]), "".join(f"_{k}_{v.lower()}" for k, v in (("khoan", m[2]), ("diem", m[1])) if v)
                target = base + rest if base else f"external_dieu_{m[3]}{rest}"
                if target != n["id"]:
                    want.add((d, n["id"], m[0], target))
            if decree in text:
                want.add((d, n["id"], decree, "external_nghi_dinh_so_20_2026_nd_cp"))
    rows = trees.reference_detect(spark, SF).collect()
    got = {(r.doc_id, r.node_id, r.match, r.target_id) for r in rows}
    assert got == want and len(rows) == len(got)


def plain_chunks(nodes, number):
    out = []
    for n in nodes:
        if n["kind"] not in ("dieu", "khoan", "diem", "tiet"):
            continue
        chain = [n]
        while chain[-1]["parent"]:
            chain.append(chain[-1]["parent"])
        art = next((x for x in chain if x["kind"] == "dieu"), None)
        clause = next((x for x in chain if x["kind"] == "khoan"), None)
        room = {"dieu": 50, "khoan": 40}.get(n["kind"], 30)
        body_of = lambda x: " ".join(y for y in (x["lead"], x["content"]) if y)
        head = [f"VB {number}", art and f"Đ{art['index']}" + (f" {art['title'][:room]}" if art["title"] is not None else ""), clause and f"K{clause['index']}", f"Đ.{n['index']}" if n["kind"] in ("diem", "tiet") else None]
        body = " ".join(x for x in (n["lead"], n["content"], n["late"]) if x)
        up = n["parent"]
        context = (up["lead"] or up["content"] or up["title"] or "")[:200] if up else ""
        shown, used, stopped = [], 0, 0
        for i, kid in enumerate(n["kids"]):
            used += len(body_of(kid))
            if i >= chunks.CHILD_ITEMS or used > chunks.CHILD_CHARS:
                break
            stopped = i + 1
            shown += [body_of(kid)] if body_of(kid) else []
        mark = f"[... còn {len(n['kids']) - stopped} điểm nữa]" if len(n["kids"]) > stopped else None
        children = "\n".join(x for x in ("\n".join(shown), mark) if x is not None) if n["kids"] else None
        parts = ["[" + " | ".join(x for x in head if x) + "]", context if n["kind"] == "diem" and body and context else None, body or None, children if n["kind"] == "khoan" else None]
        text = "\n".join(x for x in parts if x is not None)
        if len(text) >= chunks.LEAST:
            out.append({"id": n["id"] + "_chunk", "kind": n["kind"], "seq": n["seq"], "text": text, "dieu": art and art["index"], "khoan": clause and clause["index"], "point": n["index"] if n["kind"] == "diem" else ""})
    return out


def plain_refs(own, all_of, cap):
    place = {}
    for x in all_of:
        place[x["dieu"] or "", "" if x["kind"] == "dieu" else x["khoan"] or "", x["point"]] = x["id"]
    found = []
    for pattern, (a, k, p) in chunks.REF_FAMILIES:
        for m in py(pattern).finditer(own["text"]):
            family = (m[a], m[k] if k else "", m[p].lower() if p else "")
            if k or family[0] != own["dieu"]:
                found.append(family)
    if own["dieu"] and re.search(r"(?i)điều\s+này", own["text"]):
        found.append((own["dieu"], "", ""))
    if own["dieu"] and own["khoan"] and re.search(r"(?i)khoản\s+này", own["text"]):
        found.append((own["dieu"], own["khoan"], ""))
    out = []
    for a, k, p in found:
        target = place.get((a, k, p)) or place.get((a, k, "")) or place.get((a, "", ""))
        if target and target not in out:
            out.append(target)
    return out[:cap]


def test_chunks_and_exceptions(spark, laws):
    want, exceptions = [], {}
    for d, nodes in laws.items():
        made = plain_chunks(nodes, "1/2025/QH15")
        want += [(d, x["id"], x["kind"], x["text"], "|".join(plain_refs(x, made, chunks.REF_CAP)) or None) for x in made]
        for x in made:
            if py(rules.EXCEPTION).search(x["text"]):
                for rule in plain_refs(x, made, None):
                    if rule != x["id"]:
                        exceptions.setdefault(rule, []).append(x["id"])
    got = [tuple(r) for r in trees.chunk_index(spark, SF).select("doc_id", "chunk_id", "kind", "text", "refs").collect()]
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda x: x[:2]), sorted(want, key=lambda x: x[:2])):
        assert g == w
    found = {r.rule_chunk_id: r.exceptions.split("|") for r in trees.exception_index(spark, SF).collect()}
    assert found == exceptions and len(found) > 10
