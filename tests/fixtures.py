"""Small texts and a small catalogue the tests share; people, firms and dates are invented here."""

CURATOR = """\
Ottoline Brask
Collections Manager
Bergen, Norway
ottoline@brask.example
+47 55 55 01 23

Certifications
Certified Archives Conservator

Education
MA Museum Studies, Leiden Academy, 1998
Ph.D. Art History, College of Ghent at Waregem, 2004

Technical Skills
Python | SQL | Redis | TMS Gallery Kit
Kafka; Docker

Professional Experience
Collections Manager, Maritime Museum of the North, 03/2009 - 08/2014
* Forty thousand catalogue cards became records in PostgreSQL.
Registrar, Glass Hall Foundation, May 2004 to December 2008
* Loans to ninety houses on three continents.
* A night watch of sensors, read by scripts in Golang.
"""

BAKER = """\
Emeka Sundqvist
emeka.s@loaf.example

Work History
Production Manager, Three Ovens, 1996 - 1999
"""

VACANCY = """\
Harbour Pilot Office: Data Architect

What we need
- At least 9 years of experience with tide records.

Must have
SQL, Kafka, Docker

Nice to have
Python, Terraform

Duties
- Keep soundings of forty fairways.
- Answer the night desk.
"""

CATALOGUE = [
    ("python", "Python", "programming_language", ["python3"]),
    ("sql", "SQL", "programming_language", []),
    ("go", "Go", "programming_language", ["golang"]),
    ("c_plus_plus", "C++", "programming_language", ["cpp"]),
    ("nodejs", "Node.js", "framework", ["node js"]),
    ("postgresql", "PostgreSQL", "database", ["postgres"]),
    ("redis", "Redis", "database", []),
    ("docker", "Docker", "devops", []),
    ("terraform", "Terraform", "devops", []),
    ("apache_spark", "Apache Spark", "data_science", ["spark", "pyspark"]),
    ("kafka", "Apache Kafka", "data_science", ["kafka"]),
    ("archives_conservator", "Certified Archives Conservator", "certification", ["archives conservator"]),
]


def catalogue(spark):
    rows = [(i, *row) for i, row in enumerate(CATALOGUE)]
    return spark.createDataFrame(
        rows,
        "position int, normalized_name string, name string, category string, aliases array<string>",
    )
