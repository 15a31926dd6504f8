"""Posting-shaped views over the driver tables (see FIXTURES.md, part B).

Each text runs unchanged in Spark SQL and in DuckDB.
"""

VIEWS = {
    "jobs_fx": r"""
SELECT o_orderkey AS id,
 CASE o_orderkey % 7 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'github' WHEN 2 THEN 'ashby' WHEN 3 THEN 'lever' WHEN 4 THEN 'workday' WHEN 5 THEN 'workable' ELSE 'greenhouse' END AS provider,
 concat('x', CAST(o_orderkey AS VARCHAR(20))) AS external_id,
 concat('https://boards.example.com/j/', CAST(o_orderkey AS VARCHAR(20))) AS url,
 o_custkey AS company_id,
 CASE o_orderkey % 19
  WHEN 0 THEN 'Senior Software Engineer' WHEN 1 THEN 'Software Engineer I' WHEN 2 THEN 'Software Engineer II'
  WHEN 3 THEN 'New Grad Software Engineer' WHEN 4 THEN 'Lead Intern' WHEN 5 THEN 'Associate Software Engineer'
  WHEN 6 THEN 'Sales Engineer' WHEN 7 THEN 'Sr. Data Engineer' WHEN 8 THEN 'Headless CMS Developer'
  WHEN 9 THEN 'Frontend Developer' WHEN 10 THEN 'Account Executive' WHEN 11 THEN '  Staff   Platform Engineer '
  WHEN 12 THEN 'Machine Learning Engineer' WHEN 13 THEN 'Level 1 Support Specialist' WHEN 14 THEN 'Backend Engineer III'
  WHEN 15 THEN 'Engineering Manager' WHEN 16 THEN 'Junior Web Developer' WHEN 17 THEN 'Software Engineer' ELSE '' END AS title,
 CASE o_custkey % 11
  WHEN 0 THEN 'We need builders with 3+ years of experience in python and sql.' WHEN 1 THEN 'Ideal candidate has 2+ years experience with react.'
  WHEN 2 THEN 'Great for new grads. Remote - US.' WHEN 3 THEN 'Looking for 5 + yrs, typescript, aws.'
  WHEN 4 THEN '0-2 years; remote within the United States; fastapi and postgres' WHEN 5 THEN 'Remote in Canada only'
  WHEN 6 THEN 'Posted 12 days ago. node, rest api' WHEN 7 THEN 'Posted 2001-07-04 by the platform team'
  WHEN 8 THEN 'You will lead a senior team' WHEN 9 THEN '' ELSE NULL END AS description,
 CASE o_orderkey % 8 WHEN 0 THEN 'Remote - US' WHEN 1 THEN 'Remote (US)' WHEN 2 THEN 'Remote, Canada' WHEN 3 THEN 'New York, United States of America'
  WHEN 4 THEN 'Remote' WHEN 5 THEN 'US-Remote' WHEN 6 THEN NULL ELSE 'Berlin, Germany' END AS location,
 o_orderkey % 8 IN (0,1,2,4,5) AS is_remote,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'senior' WHEN '2-HIGH' THEN 'mid' WHEN '3-MEDIUM' THEN 'junior' ELSE 'unknown' END AS level,
 CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate END AS posted_at,
 o_orderdate AS updated_at, o_orderstatus <> 'F' AS active
FROM orders
""",
    "companies_fx": r"""
SELECT c_custkey AS id, c_name AS name, concat('customer-', CAST(c_custkey AS VARCHAR(20))) AS slug FROM customer
""",
    "job_skills_fx": r"""
SELECT DISTINCT l_orderkey AS job_id,
 CASE l_partkey % 8 WHEN 0 THEN 'python' WHEN 1 THEN 'react' WHEN 2 THEN 'typescript' WHEN 3 THEN 'SQL' WHEN 4 THEN 'aws' WHEN 5 THEN 'node' WHEN 6 THEN 'rest api' ELSE 'fastapi' END AS skill
FROM lineitem
""",
    "incoming_fx": r"""
SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS seq,
 CASE l_orderkey % 7 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'github' WHEN 2 THEN 'ashby' WHEN 3 THEN 'lever' WHEN 4 THEN 'workday' WHEN 5 THEN 'workable' ELSE 'greenhouse' END AS provider,
 CASE WHEN l_linenumber IN (1, 2) THEN concat('x', CAST(l_orderkey AS VARCHAR(20))) WHEN l_linenumber IN (3, 4) THEN concat('n', CAST(l_orderkey AS VARCHAR(20))) ELSE NULL END AS external_id,
 CASE WHEN l_linenumber = 3 AND l_orderkey % 2 = 0 THEN concat('x', CAST(l_orderkey AS VARCHAR(20))) ELSE NULL END AS legacy_external_id,
 CASE WHEN l_linenumber = 2 THEN NULL ELSE concat('Updated Role ', CAST(l_partkey AS VARCHAR(20))) END AS title,
 CASE WHEN l_partkey % 3 = 0 THEN concat('NewCo ', CAST(l_suppkey AS VARCHAR(20))) ELSE concat('Customer#', lpad(CAST(l_suppkey AS VARCHAR(20)), 9, '0')) END AS company,
 CASE WHEN l_linenumber IN (1, 4) THEN NULL ELSE l_shipdate END AS posted_at,
 concat('https://boards.example.com/u/', CAST(l_orderkey AS VARCHAR(20))) AS url
FROM lineitem
""",
    "gh_payload_fx": r"""
SELECT o_orderkey AS payload_id, o_custkey AS company_id,
 concat('{"jobs":[{"absolute_url":"https://boards.example.com/g/', CAST(o_orderkey AS VARCHAR(20)), '","title":"  Software   Engineer I ","location":{"name":"US-Remote"},"updated_at":"2025-09-15T10:00:00-04:00"},{"absolute_url":"https://boards.example.com/h/', CAST(o_orderkey AS VARCHAR(20)), '","title":"Staff Engineer","location":{"name":"Austin, United States of America"},"created_at":"2025-09-0', CAST(1 + o_orderkey % 9 AS VARCHAR(2)), 'T00:00:00Z"}]}') AS body
FROM orders
""",
    "lever_payload_fx": r"""
SELECT o_orderkey AS payload_id, o_custkey AS company_id,
 concat('[{"hostedUrl":"","applyUrl":"https://boards.example.com/l/', CAST(o_orderkey AS VARCHAR(20)), '","text":"Associate Software Engineer","categories":{"location":"Remote (US)"},"createdAt":', CAST(1700000000000 + o_orderkey AS VARCHAR(20)), '},{"hostedUrl":"https://boards.example.com/m/', CAST(o_orderkey AS VARCHAR(20)), '","text":"Sr. Engineer","updatedAt":"2025-09-15T10:00:00+02:00"}]') AS body
FROM orders
""",
    "workday_payload_fx": r"""
SELECT o_orderkey AS payload_id, o_custkey AS company_id,
 concat('{"jobPostings":[{"title":"Engineer II","locationsText":"US-Remote","bulletFields":["R', CAST(o_orderkey AS VARCHAR(20)), '"],"postedOn":"Posted Today","meta":{"postedDate":"2025-09-15T10:00:00-04:00"}},{"title":"Web Developer","bulletFields":[],"startDate":', CAST(1700000000 + o_orderkey AS VARCHAR(20)), '}]}') AS body
FROM orders
""",
    "ashby_payload_fx": r"""
SELECT o_orderkey AS payload_id, o_custkey AS company_id,
 concat(CASE o_orderkey % 3 WHEN 0 THEN '[' WHEN 1 THEN '{"jobPostings":[' ELSE '{"jobs":[' END,
  '{"title":"New Grad Engineer","jobPostingUrl":"https://boards.example.com/a/', CAST(o_orderkey AS VARCHAR(20)), '","locationText":"Remote (US)","publishedAt":"2025-09-15T10:00:00Z"},{"jobTitle":"Data Engineer","slug":"s', CAST(o_orderkey AS VARCHAR(20)), '","posting":{"updatedAt":"2025-09-16T00:00:00Z"}},{"title":"","jobUrl":"https://boards.example.com/z"}',
  CASE o_orderkey % 3 WHEN 0 THEN ']' ELSE ']}' END) AS body
FROM orders
""",
    "md_doc_fx": r"""
SELECT c_custkey AS doc_id, CASE c_custkey % 3
 WHEN 0 THEN concat('# List', chr(10), '| Company | Role | Location | Date | Apply |', chr(10), '| --- | --- | --- | --- | --- |', chr(10), '| [Acme](https://acme.example.com) | New Grad SWE | Remote - US | Sep 17 | [Info](https://i.example.com) [Apply](http://boards.example.com/t/', CAST(c_custkey % 90 AS VARCHAR(20)), '?utm_source=x) |', chr(10), '| Beta | Engineer I | Toronto, Canada | 3d |', chr(10))
 WHEN 1 THEN concat('intro', chr(10), '- [Gamma - Junior Developer](https://boards.example.com/b/', CAST(c_custkey % 90 AS VARCHAR(20)), ')', chr(10), '1. [Solo](https://boards.example.com/s/1)', chr(10), 'plain [x](https://no.example.com)', chr(10))
 ELSE concat('<table><tr><th>Company</th><th>Role</th><th>Location</th><th>Link</th><th>Age</th></tr><tr><td><a href="https://delta.example.com">Delta</a></td><td>Software Engineer</td><td>Remote in USA</td><td><a href="https://boards.example.com/h/', CAST(c_custkey % 90 AS VARCHAR(20)), '">Apply</a></td><td>2w</td></tr></table>') END AS md
FROM customer
""",
    "date_text_fx": r"""
SELECT p_partkey AS id, CASE p_partkey % 10 WHEN 0 THEN 'Sep 17' WHEN 1 THEN '2025-09-14' WHEN 2 THEN '3 days ago' WHEN 3 THEN '1d' WHEN 4 THEN '12h' WHEN 5 THEN '2w' WHEN 6 THEN 'n/a' WHEN 7 THEN 'Feb 30' WHEN 8 THEN 'Dec 31' ELSE '' END AS txt FROM part
""",
    "url_fx": r"""
SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN concat('http://simplify.jobs/p/', CAST(page_id AS VARCHAR(20)), '?utm_source=a&gh_jid=7')
 WHEN 2 THEN concat('https://simplify.jobs/jobs/', CAST(page_id AS VARCHAR(20)), '?utm_source=a') WHEN 3 THEN concat('https://boards.example.com/x/', CAST(page_id AS VARCHAR(20)), '?gh_jid=1&ref=z')
 ELSE concat('https://boards.example.com/x/', CAST(page_id % 15 AS VARCHAR(20)), '?utm_medium=b') END AS url FROM pages
""",
    "ats_page_fx": r"""
SELECT page_id, url, concat(html, CASE page_id % 7 WHEN 0 THEN '<a href="https://boards.greenhouse.io/acme">j</a>' WHEN 1 THEN '<a href="https://jobs.lever.co/beta">j</a>'
 WHEN 2 THEN '<a href="https://gamma.wd1.myworkdayjobs.com/External">j</a>' WHEN 3 THEN '<a href="https://jobs.ashbyhq.com/delta">j</a>' WHEN 4 THEN '<a href="https://eps.workable.com">j</a>'
 WHEN 5 THEN '<script type="application/ld+json">{"@type":"JobPosting","datePosted":"2025-09-15"}</script>' ELSE '' END) AS html FROM pages
""",
    "postings_fx": r"""
SELECT j.id AS seq, j.title, c.name AS company,
 CASE WHEN j.id % 4 = 0 THEN upper(concat('https://boards.example.com/p/', CAST(j.id % 950 AS VARCHAR(20)))) ELSE concat('https://boards.example.com/p/', CAST(j.id % 950 AS VARCHAR(20))) END AS url,
 j.provider AS source, j.location, j.posted_at, j.description AS description_snippet, CAST(NULL AS VARCHAR(20)) AS level
FROM jobs_fx j JOIN companies_fx c ON c.id = j.id % 50
""",
    "directory_fx": r"""
SELECT c_custkey AS ordinal, concat(CASE WHEN c_custkey % 7 = 0 THEN 'CUSTOMER#' ELSE 'Customer#' END, lpad(CAST(c_custkey % 100 AS VARCHAR(20)), 9, '0')) AS company,
 CASE c_custkey % 8 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'ashby' WHEN 2 THEN 'lever' WHEN 3 THEN 'workday' WHEN 4 THEN 'workable' WHEN 5 THEN 'Greenhouse' WHEN 6 THEN 'unknownats' ELSE NULL END AS ats,
 CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('tok', CAST(c_custkey AS VARCHAR(20))) END AS token,
 CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Long-shot' END AS priority
FROM customer
""",
    "dup_jobs_fx": r"""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 9 THEN 'greenhouse' ELSE 'github' END AS provider, o_custkey % 40 AS company_id,
 concat('Role ', CAST(o_orderkey % 97 AS VARCHAR(20))) AS title,
 concat(CASE WHEN o_orderkey % 3 = 0 THEN 'https://simplify.jobs/p/' ELSE 'https://boards.example.com/d/' END, CAST(o_orderkey AS VARCHAR(20))) AS url
FROM orders
""",
    "scraped_dates_fx": r"""
SELECT o_orderkey AS seq, concat('x', CAST(o_orderkey - o_orderkey % 3 AS VARCHAR(20))) AS external_id,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate + INTERVAL 2 DAY END AS posted_at
FROM orders
""",
    "history_fx": r"""
SELECT concat('x', CAST(o_orderkey AS VARCHAR(20))) AS external_id,
 CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate ELSE NULL END AS merged_at,
 CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE NULL END AS added_at,
 CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 3 DAY ELSE NULL END AS touched_at
FROM orders
""",
}
