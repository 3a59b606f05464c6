"""Three small HR exports with planted cases, and a pilot export.

35 people in the master file, the first 25 also in payroll, the last 21 plus
one near duplicate in the legacy file. Planted: a name in capitals with
padding (2, 7), a salary that differs (5), an unknown status (8, 9), a missing
e-mail found elsewhere (20) and one missing everywhere (30), ambiguous payroll
dates, an id column without a telling header, a near duplicate of person 12.
"""

FIRST = ["Asha", "Bela", "Chand", "Dhruv", "Esha", "Farid", "Gita", "Hari", "Indu", "Jaya", "Kiran", "Rahul", "Lata", "Mohan",
         "Nina", "Om", "Pavan", "Rekha", "Sunita", "Tara", "Uday", "Vani", "Wasim", "Yash", "Zara", "Anil", "Bina", "Chetan",
         "Dina", "Ekta", "Feroz", "Gopal", "Hema", "Irfan", "Jatin"]
LAST = ["Agarwal", "Bhatt", "Chauhan", "Das", "Eapen", "Fernandes", "Ghosh", "Hegde", "Irani", "Jain", "Kapoor", "Sharma", "Lal",
        "Menon", "Nanda", "Oberoi", "Pillai", "Rawat", "Sethi", "Thakur", "Unni", "Vyas", "Wadhwa", "Yadav", "Zaveri", "Arora",
        "Batra", "Chawla", "Dutta", "Emani", "Fonseca", "Garg", "Handa", "Iqbal", "Juneja"]
DEPARTMENTS = ["HR", "Finance", "Sales", "Operations", "Engineering"]


def _person(i):
    first, last = FIRST[i - 1], LAST[i - 1]
    born = "14/05/1992" if i == 12 else f"{13 + i % 15:02d}/{1 + i % 12:02d}/{1985 + i % 12}"
    return {
        "id": f"E{1000 + i}", "first": first, "last": last, "email": f"{first}.{last}@example.com".lower(), "born": born,
        "joined": f"{13 + i % 14:02d}/{1 + i % 12:02d}/{2020 + i % 4}", "dept": DEPARTMENTS[i % 5],
        "title": "Product Manager", "manager": "" if i < 6 else f"E{1001 + i % 5}", "salary": 80000 if i == 5 else 60000 + 2500 * i,
    }


PEOPLE = [_person(i) for i in range(1, 36)]


def master():
    rows = []
    for i, p in enumerate(PEOPLE, 1):
        r = {"Emp No": p["id"], "First Name": p["first"], "Last Name": p["last"], "E-mail": p["email"], "DOB": p["born"],
             "Join Date": p["joined"], "Dept": p["dept"], "Designation": p["title"], "Status": "Active", "Mgr": p["manager"],
             "Salary": str(p["salary"])}
        if i in (2, 7):
            r.update({"First Name": f"  {p['first'].upper()}  ", "Last Name": f" {p['last'].lower()} ", "E-mail": f"  {p['email']} "})
        if i in (8, 9):
            r["Status"] = "LOA"
        if i in (20, 30):
            r["E-mail"] = ""
        rows.append(r)
    return rows


def payroll():
    rows = []
    for i, p in enumerate(PEOPLE[:25]):
        rows.append({"EmpID": p["id"], "Full Name": f"{p['first']} {p['last']}", "Email Address": "" if i == 19 else p["email"],
                     "Gross Salary": "88000" if i == 4 else str(p["salary"]),
                     "DOJ": f"{1 + i % 12:02d}/{1 + 2 * i % 12:02d}/{2020 + i % 4}"})
    return rows


def legacy():
    rows = []
    for i, p in enumerate(PEOPLE[14:35], 15):
        phone = f"09876500{i:03d}" if i % 2 else f"+91 9876000{i:03d}"
        rows.append({"name": f"{p['first']} {p['last']}", "mail": "" if i == 30 else p["email"], "phone": phone, "birth_date": p["born"],
                     "ref": p["id"], "status": "active", "dept": p["dept"].lower()})
    rows.append({"name": "Rahul Sherma", "mail": "rahul.sherma@elsewhere.org", "phone": "+91 9988776655", "birth_date": "1992-05-14",
                 "ref": "E1099", "status": "active", "dept": "tech"})
    return rows


def frame(spark, rows, source):
    from tributary.sources.readers import from_frame
    columns = list(rows[0])
    data = [(i, *[r[c] for c in columns]) for i, r in enumerate(rows, 1)]
    schema = "row_num long, " + ", ".join(f"`{c}` string" for c in columns)
    return from_frame(spark.createDataFrame(data, schema), source, "row_num")


def sources(spark):
    return {"master": frame(spark, master(), "master"), "payroll": frame(spark, payroll(), "payroll"),
            "legacy": frame(spark, legacy(), "legacy")}
