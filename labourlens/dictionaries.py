"""Lookup data: fixed values first, then the frames and maps built from them.

The tables are small and closed (the largest has fewer than 200 spellings), so
they may be shipped to every task as literals or broadcast relations.  User
dictionaries go through :func:`skill_dictionary`, which checks their size.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

# --- fixed values: skills, as "canonical | group | spellings" ---------------
SKILLS_TEXT = """
JavaScript | Programming Language | js, javascript, java script, ecmascript
TypeScript | Programming Language | ts, typescript
Python | Programming Language | py, python3, python
Go | Programming Language | golang, go lang
C++ | Programming Language | cpp, c++
C# | Programming Language | c#, csharp
VB.NET | Programming Language | vb.net, vb
Ruby | Programming Language | ruby on rails
PHP | Programming Language | php
Scala | Programming Language | scala
Kotlin | Mobile | kotlin
Swift | Mobile | swift
Rust | Programming Language | rust
R | Programming Language | r
MATLAB | Programming Language | matlab
SQL | Programming Language | sql
NoSQL | Programming Language | nosql
HTML | Programming Language | html, html5
CSS | Programming Language | css, css3
Sass | Programming Language | sass, scss
Less | Programming Language | less
React | Frontend Framework | reactjs, react.js, react
Vue.js | Frontend Framework | vuejs, vue.js, vue
AngularJS | Frontend Framework | angularjs, angular.js
Angular | Frontend Framework | angular, angular 2+
Svelte | Frontend Framework | svelte
Next.js | Frontend Framework | nextjs, next.js, next
Nuxt.js | Frontend Framework | nuxtjs, nuxt
Gatsby | Frontend Framework | gatsby
Remix | Frontend Framework | remix
jQuery | Frontend Framework | jquery
Bootstrap | Frontend Framework | bootstrap
Tailwind CSS | Frontend Framework | tailwind, tailwindcss
Material UI | Frontend Framework | material ui, mui
Ant Design | Frontend Framework | antd
Chakra UI | Frontend Framework | chakra
Node.js | Backend Framework | nodejs, node.js, node
Express.js | Backend Framework | expressjs, express
NestJS | Backend Framework | nestjs
Django | Backend Framework | django
Flask | Backend Framework | flask
FastAPI | Backend Framework | fastapi
Spring Boot | Backend Framework | spring boot
Spring | Backend Framework | spring
Laravel | Backend Framework | laravel
Symfony | Backend Framework | symfony
ASP.NET | Backend Framework | asp.net
.NET | Backend Framework | dotnet
.NET Core | Backend Framework | .net core
Ruby on Rails | Backend Framework | rails
PostgreSQL | Database | postgres, postgresql, psql
MySQL | Database | mysql
MariaDB | Database | mariadb
MongoDB | Database | mongo, mongodb
Redis | Database | redis
Elasticsearch | Database | elasticsearch
Cassandra | Database | cassandra
DynamoDB | Database | dynamodb
BigQuery | Database | bigquery
Snowflake | Database | snowflake
SQL Server | Database | sql server, mssql
Oracle | Database | oracle
SQLite | Database | sqlite
AWS | Cloud | aws, amazon web services
Google Cloud | Cloud | gcp, google cloud platform
Azure | Cloud | azure, microsoft azure
Docker | DevOps | docker
Kubernetes | DevOps | kubernetes, k8s
Terraform | DevOps | terraform
Ansible | DevOps | ansible
Jenkins | DevOps | jenkins
GitLab CI | DevOps | gitlab ci
GitHub Actions | DevOps | github actions
CircleCI | DevOps | circleci
Nginx | DevOps | nginx
Apache | DevOps | apache
Linux | DevOps | linux
Unix | DevOps | unix
Bash | DevOps | bash
Shell | DevOps | shell
Vim | Tool | vim
Git | Tool | git
CI/CD | DevOps | ci/cd, cicd
Machine Learning | Data Science | machine learning, ml
Deep Learning | Data Science | deep learning, dl
TensorFlow | Data Science | tensorflow, tf
PyTorch | Data Science | pytorch, torch
Keras | Data Science | keras
Scikit-learn | Data Science | scikit-learn, sklearn
Pandas | Data Science | pandas
NumPy | Data Science | numpy
Matplotlib | Data Science | matplotlib
Seaborn | Data Science | seaborn
Plotly | Data Science | plotly
Jupyter | Data Science | jupyter
Apache Spark | Data Science | spark
PySpark | Data Science | pyspark
Hadoop | Data Science | hadoop
Kafka | Data Science | kafka
Airflow | Data Science | airflow
Tableau | Data Science | tableau
Power BI | Data Science | power bi, powerbi
Looker | Data Science | looker
NLP | Data Science | nlp
Computer Vision | Data Science | computer vision, cv
LLM | Data Science | llm, large language model
RAG | Data Science | rag, retrieval augmented generation
Android | Mobile | android
iOS | Mobile | ios
React Native | Mobile | react native, rn
Flutter | Mobile | flutter
Dart | Mobile | dart
Xamarin | Mobile | xamarin
Objective-C | Mobile | objective-c
Jest | Testing | jest
Mocha | Testing | mocha
Chai | Testing | chai
pytest | Testing | pytest
unittest | Testing | unittest
Selenium | Testing | selenium
Cypress | Testing | cypress
Playwright | Testing | playwright
JUnit | Testing | junit
TestNG | Testing | testng
English | Language | english, tiếng anh, tieng anh
IELTS | Language | ielts
TOEIC | Language | toeic
Communication | Soft Skill | communication, giao tiếp
Teamwork | Soft Skill | teamwork, làm việc nhóm
Leadership | Soft Skill | leadership, đãr lãnh đạo
Problem Solving | Soft Skill | problem solving, giải quyết vấn đề
Agile | Soft Skill | agile
Scrum | Soft Skill | scrum
Kanban | Soft Skill | kanban
Jira | Tool | jira
Confluence | Tool | confluence
Java | Programming Language | java
"""

# --- fixed values: group guessed from words of an unknown skill name --------
GROUP_WORDS = [
    ("Programming Language", ["language", "ngôn ngữ", "programming", "lập trình"]),
    ("Framework", ["framework", "library", "thư viện"]),
    ("Database", ["database", "db", "sql", "nosql", "cơ sở dữ liệu"]),
    ("DevOps", ["cloud", "devops", "aws", "azure", "gcp", "docker", "kubernetes", "ci/cd"]),
    ("Data Science", ["ml", "machine learning", "deep learning", "ai", "data science", "tensorflow", "pytorch"]),
    ("Mobile", ["mobile", "android", "ios", "flutter", "react native"]),
    ("Testing", ["test", "testing", "qa", "automation", "selenium", "cypress"]),
    ("Language", ["english", "ielts", "toeic", "tiếng anh"]),
    ("Soft Skill", ["communication", "teamwork", "leadership", "soft skill", "kỹ năng mềm",
                    "giải quyết vấn đề", "problem solving"]),
]
FRONTEND_WORDS = ["frontend", "ui", "react", "vue", "angular", "css", "html"]

# --- fixed values: title words ----------------------------------------------
TITLE_WORDS = {
    "dev": "developer", "devel": "developer", "devloper": "developer",
    "eng": "engineer", "engr": "engineer",
    "mgmt": "management", "mgr": "manager", "manag": "manager",
    "arch": "architect", "archt": "architect", "anlst": "analyst",
    "admin": "administrator", "adm": "administrator",
    "coord": "coordinator", "coor": "coordinator",
    "spec": "specialist", "specalist": "specialist",
    "consult": "consultant", "conslt": "consultant", "internship": "intern",
    "jr": "junior", "jun": "junior", "sr": "senior", "snr": "senior",
    "fe": "frontend", "be": "backend", "fs": "fullstack",
    "ml": "machine learning", "machinelearning": "machine learning", "test": "tester",
}
TITLE_PHRASES = {
    "front-end": "frontend", "front end": "frontend", "back-end": "backend", "back end": "backend",
    "full-stack": "fullstack", "full stack": "fullstack", "dev ops": "devops", "big data": "data",
    "artificial intelligence": "ai", "ui ux": "ui/ux", "site reliability": "sre",
    "quality assurance": "qa", "business intelligence": "bi", "human resources": "hr",
    "information technology": "it",
}
TITLE_ACRONYMS = ["AI", "UI", "UX", "BI", "QA", "ERP", "CRM", "SAP", "HR", "IT", "SRE", "ML", "AWS", "GCP"]
TITLE_SMALL_WORDS = ["and", "or", "the", "of", "in", "at", "&"]
TITLE_SPECIAL_CASE = {"devops": "DevOps"}

# --- fixed values: closed categories ----------------------------------------
CITY_ALIASES = {
    "hcm": "HCMC", "ho chi minh": "HCMC", "hồ chí minh": "HCMC", "tp.hcm": "HCMC",
    "thành phố hồ chí minh": "HCMC", "ho chi minh city": "HCMC",
    "hanoi": "Hanoi", "hà nội": "Hanoi", "ha noi": "Hanoi",
    "da nang": "Da Nang", "đà nẵng": "Da Nang", "danang": "Da Nang",
    "can tho": "Can Tho", "cần thơ": "Can Tho", "cantho": "Can Tho",
    "remote": "Remote", "tự do": "Remote", "online": "Remote",
}
# Head offices are not mapped to Can Tho.
COMPANY_CITY_ALIASES = {k: v for k, v in CITY_ALIASES.items() if v != "Can Tho"}
REMOTE_RULES = [
    ("Remote", ["remote", "tự do", "online", "work from home", "wfh"]),
    ("Hybrid", ["hybrid", "hỗn hợp", "mixed"]),
]
JOB_TYPE_RULES = [
    ("Part-time", ["part", "bán"]),
    ("Contract", ["contract", "hợp đồng"]),
    ("Internship", ["intern", "thực tập"]),
]
CONTRACT_RULES = [
    ("CDH (Indefinite)", ["cdh", "indefinite", "chính thức", "chinh thuc", "fulltime", "permanent"]),
    ("Temporary", ["temporary", "tam thoi", "tạm thời", "thời vụ", "thoi vu", "seasonal"]),
    ("Freelance", ["freelance", "tu do", "tự do", "contractor"]),
    ("Internship", ["intern", "internship", "thực tập", "thuc tap"]),
    ("Part-time", ["part", "parttime", "ban thoi gian", "bán thời gian"]),
]
JOB_LEVEL_RULES = [
    ("Director", ["director", "giam doc", "giám đốc", "vp", "vice president"]),
    ("Manager", ["manager", "quan ly", "quản lý", "truong phong", "trưởng phòng"]),
    ("Team Lead", ["team lead", "team leader", "truong nhom", "trưởng nhóm", "lead"]),
    ("Senior", ["senior", "sr", "expert", "chuyen vien", "chuyên viên"]),
    ("Junior", ["junior", "jr", "fresher", "intern", "thuc tap", "thực tập"]),
    ("Employee", ["employee", "nhan vien", "nhân viên", "staff"]),
]
EDUCATION_RULES = [
    ("PhD", ["phd", "tiến sĩ"]),
    ("Master", ["master", "thạc sĩ"]),
    ("Bachelor", ["bachelor", "đại học", "cử nhân"]),
    ("College", ["college", "cao đẳng"]),
    ("High School", ["high", "trung cấp", "phổ thông"]),
]
COMPANY_SIZE_RULES = [
    ("Startup (<10)", ["startup", "start up", "<10", "dưới 10", "1-10"]),
    ("Small (10-50)", ["small", "10-50", "11-50", "50-100"]),
    ("Medium (51-200)", ["medium", "51-200", "101-200", "50-200"]),
    ("Large (201-1000)", ["large", "201-1000", "200-1000", "500-1000"]),
    ("Enterprise (>1000)", ["enterprise", ">1000", "1000+", "trên 1000"]),
]
REQUIRED_LEVEL_RULES = [
    ("Required", ["required", "bắt buộc", "yêu cầu", "must", "essential"]),
    ("Nice to have", ["nice", "ưu tiên", "prefer", "optional", "bonus", "plus"]),
]
ENGLISH_WORDS = ["english", "tiếng anh", "tieng anh", "ielts", "toeic"]

# --- fixed values: ordered domains ------------------------------------------
EXPERIENCE_BINS = ["entry", "junior", "mid", "senior", "lead"]
EXPERIENCE_EDGES = [1.0, 3.0, 5.0, 8.0]
EXPERIENCE_CENTRES = {"entry": 1.0, "junior": 2.0, "mid": 4.0, "senior": 6.0, "lead": 8.0}
REMOTE_OPTIONS = ["On-site", "Hybrid", "Remote"]

# --- fixed values: challenge pages ------------------------------------------
BLOCKED_MARKERS = [
    "cf-challenge", "cf_chl", "challenge-platform", "captcha", "attention required", "just a moment",
    "enable javascript and cookies", "access denied",
]

MAX_DICTIONARY_ROWS = 20_000


@dataclass(frozen=True)
class SkillEntry:
    alias: str
    canonical: str
    group: str
    ord: int


def _read_skills() -> list[SkillEntry]:
    entries: list[SkillEntry] = []
    for line in SKILLS_TEXT.strip().splitlines():
        canonical, group, spellings = (part.strip() for part in line.split("|"))
        entries += [SkillEntry(s.strip(), canonical, group, 0) for s in spellings.split(",")]
    return [SkillEntry(e.alias, e.canonical, e.group, i) for i, e in enumerate(entries)]


SKILL_ENTRIES = _read_skills()


def extend_skills(extra: Iterable[tuple[str, str, str]]) -> list[SkillEntry]:
    """Built-in entries plus user ones; a user spelling replaces a built-in one."""
    merged = {e.alias: (e.canonical, e.group) for e in SKILL_ENTRIES}
    regrouped: dict[str, str] = {}
    for alias, canonical, group in extra:
        merged[alias.strip().lower()] = (canonical, group)
        regrouped[canonical] = group
    return [SkillEntry(alias, canonical, regrouped.get(canonical, group), i)
            for i, (alias, (canonical, group)) in enumerate(merged.items())]


def skill_dictionary(df: DataFrame, limit: int = MAX_DICTIONARY_ROWS) -> list[SkillEntry]:
    """Entries of a user table ``(alias, canonical, skill_group)`` added to the built-in ones.

    A dictionary is curated by hand and travels to every task, so its size is
    checked before anything is fetched.
    """
    rows = df.select("alias", "canonical", "skill_group").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"skill dictionary has more than {limit} rows; it is not a lookup table")
    return extend_skills((r[0], r[1], r[2]) for r in rows)
