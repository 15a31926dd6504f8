"""Further posting-shaped views over the driver tables; same rules as queries/views.py."""

EXTRA_VIEWS = {
    "text_fx": r"""
SELECT c_custkey AS id,
 CASE c_custkey % 6 WHEN 0 THEN '  ** Acme   Inc ' WHEN 1 THEN '- (Beta) Labs' WHEN 2 THEN 'Gamma & Sons, Ltd.' WHEN 3 THEN '' WHEN 4 THEN '!!!' ELSE c_name END AS company,
 CASE c_custkey % 7 WHEN 0 THEN 'Remote, Remote' WHEN 1 THEN ' Remote   in USA ' WHEN 2 THEN 'New York, Remote, Remote' WHEN 3 THEN 'United  States of America' WHEN 4 THEN 'US-Remote' WHEN 5 THEN '' ELSE 'Berlin,  Germany' END AS location,
 CASE c_custkey % 5 WHEN 0 THEN 'https://Jobs.Example.com:8080/a/b/' WHEN 1 THEN 'https://boards.example.com/x/12?gh_jid=4' WHEN 2 THEN 'https://careers.example.com' WHEN 3 THEN '' ELSE concat('https://boards.example.com/j/', CAST(c_custkey AS VARCHAR(20))) END AS url,
 CASE c_custkey % 5 WHEN 0 THEN '[Info](https://i.example.com/1) [Apply now](https://a.example.com/2)' WHEN 1 THEN 'see [Site]( https://s.example.com/3 )' WHEN 2 THEN ' https://bare.example.com/4 ' WHEN 3 THEN 'plain text' ELSE '' END AS cell,
 CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN concat(' id', CAST(c_custkey AS VARCHAR(20))) ELSE 'g7' END AS greenhouse_id,
 CASE c_custkey % 3 WHEN 0 THEN 'job-7' ELSE NULL END AS job_id,
 CASE c_custkey % 4 WHEN 0 THEN ' Python ' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'rest api' END AS skill,
 CASE c_custkey % 6 WHEN 0 THEN '2025-09-15T10:00:00-04:00' WHEN 1 THEN '2025-09-15T10:00:00Z' WHEN 2 THEN '2025-09-15' WHEN 3 THEN 'soon' WHEN 4 THEN '2025-09-15T10:00:00.250000+02:00' ELSE '' END AS iso
FROM customer""",
    "link_fx": r"""
SELECT page_id AS id, CASE page_id % 9 WHEN 0 THEN url WHEN 1 THEN concat('http://simplify.jobs/p/', CAST(page_id AS VARCHAR(20)), '?utm_source=a&gh_jid=7')
 WHEN 2 THEN concat('https://simplify.jobs/jobs/', CAST(page_id AS VARCHAR(20)), '?utm_source=a') WHEN 3 THEN concat('https://boards.example.com/x/', CAST(page_id AS VARCHAR(20)), '?gh_jid=1&ref=z&gh_jid=2')
 WHEN 4 THEN 'https://simplify.jobs/c/Acme' WHEN 5 THEN 'HTTP://boards.example.com/Y?gh_jid=#frag' WHEN 6 THEN 'https://simplify.jobs/jobs/1?gh_jid=9' WHEN 7 THEN '/relative/path?x=1'
 ELSE concat('https://boards.example.com/x/', CAST(page_id % 15 AS VARCHAR(20)), '?utm_medium=b') END AS url,
 CASE page_id % 3 WHEN 0 THEN 'https://boards.example.com/company' WHEN 1 THEN NULL ELSE concat('https://boards.example.com/x/', CAST(page_id % 15 AS VARCHAR(20)), '?ref=c') END AS company_href
FROM pages""",
    "header_fx": r"""
SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Company|Role|Location|Date Posted|Apply' WHEN 1 THEN 'Employer|Position Title|Application Link|Age'
 WHEN 2 THEN 'Name|Notes' ELSE 'Posting|Organization|Locations|Updated|Link' END AS header FROM customer""",
    "list_source_fx": r"""
SELECT s_suppkey AS source_idx, CASE s_suppkey % 4 WHEN 0 THEN concat('https://github.com/owner', CAST(s_suppkey AS VARCHAR(20)), '/jobs/')
 WHEN 1 THEN concat('https://github.com/owner', CAST(s_suppkey AS VARCHAR(20)), '/jobs/blob/main/LIST.md') WHEN 2 THEN concat('https://github.com/owner', CAST(s_suppkey AS VARCHAR(20)), '/jobs/blob/dev')
 ELSE concat('https://lists.example.com/', CAST(s_suppkey AS VARCHAR(20)), '/') END AS address FROM supplier""",
    "list_page_fx": r"""
SELECT concat('https://raw.githubusercontent.com/owner', CAST(s_suppkey AS VARCHAR(20)), '/jobs/', CASE s_suppkey % 3 WHEN 0 THEN 'main' ELSE 'master' END, CASE s_suppkey % 4 WHEN 1 THEN '/LIST.md' WHEN 0 THEN '/NEW_GRAD_USA.md' ELSE '/README.md' END) AS url,
 concat('body ', CAST(s_suppkey AS VARCHAR(20))) AS body FROM supplier""",
    "skill_config_fx": r"""
SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN '{"any":["Python "," SQL",""],"all":[]}' WHEN 1 THEN '{"skills_any":"React, ,Node","skills_all":["AWS"]}'
 WHEN 2 THEN concat('{"any":[],"skills_any":["k', CAST(c_custkey AS VARCHAR(20)), '"],"all":"go"}') WHEN 3 THEN 'broken' ELSE '{}' END AS body FROM customer""",
    "raw_directory_fx": r"""
SELECT c_custkey AS ordinal, CASE c_custkey % 3 WHEN 0 THEN ' Greenhouse ' ELSE NULL END AS provider, CASE c_custkey % 3 WHEN 1 THEN 'LEVER' ELSE '' END AS source,
 CASE c_custkey % 3 WHEN 2 THEN 'workday' ELSE NULL END AS ats, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE NULL END AS company, CASE WHEN c_custkey % 4 = 1 THEN c_name ELSE '' END AS name,
 c_mktsegment AS org, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('tok', CAST(c_custkey AS VARCHAR(20))) END AS token, 'alt' AS board_token,
 CAST(NULL AS VARCHAR(20)) AS host, CASE WHEN c_custkey % 3 = 2 THEN 'site.example.com' ELSE NULL END AS domain, '' AS path,
 CASE WHEN c_custkey % 6 = 2 THEN 'Careers' ELSE NULL END AS environment, 'High' AS priority FROM customer""",
    "header_page_fx": r"""
SELECT page_id, url, CASE page_id % 7 WHEN 0 THEN 'HTTP/2 301\nLocation: https://boards.greenhouse.io/acme\n' WHEN 1 THEN 'HTTP/2 302\nlocation: https://jobs.lever.co/beta\n'
 WHEN 2 THEN 'location: https://x.example.com/\nLocation: https://gamma.wd1.myworkdayjobs.com/External?x=1\n' WHEN 3 THEN 'location: https://jobs.ashbyhq.com/delta\n'
 WHEN 4 THEN 'Location: https://eps.workable.com/\n' WHEN 5 THEN 'location: https://eps.workable.com/\nlocation: https://jobs.ashbyhq.com/zeta\n' ELSE 'HTTP/2 200\n' END AS html FROM pages""",
    "ashby_page_fx": r"""
SELECT page_id, concat('tok', CAST(page_id % 50 AS VARCHAR(20))) AS token, CAST(NULL AS VARCHAR(20)) AS company, url,
 concat(html, '<a href="/tok', CAST(page_id % 50 AS VARCHAR(20)), '/job/a', CAST(page_id AS VARCHAR(20)), '?x=1"> New <b>Grad</b> Engineer</a>',
 '<script id="__NEXT_DATA__" type="application/json">{"props":{"list":[{"jobPostingUrl":"/tok', CAST(page_id % 50 AS VARCHAR(20)), '/job/n1","title":"Data Engineer"},{"url":"https://other.example.com/x"}]}}</script>',
 '<script>{"deep":[{"jobTitle":"Web Developer","jobUrl":"https://jobs.ashbyhq.com/tok', CAST(page_id % 50 AS VARCHAR(20)), '/s1"}]}</script>',
 '<p>see "tok', CAST(page_id % 50 AS VARCHAR(20)), '/job/raw9" and \/tok</p>') AS html FROM pages""",
    "ashby_answer_fx": r"""
SELECT page_id, concat('tok', CAST(page_id % 50 AS VARCHAR(20))) AS token,
 concat('{"data":{"org":{"nodes":[{"title":"Engineer I","jobPostingUrl":"https://jobs.ashbyhq.com/tok', CAST(page_id % 50 AS VARCHAR(20)), '/1/","locationText":"Remote (US)","publishedAt":"2025-09-15"},',
 '{"title":"Elsewhere","url":"https://jobs.ashbyhq.com/none/2"},{"nested":{"jobTitle":"Deep Role","jobUrl":"tok/tok', CAST(page_id % 50 AS VARCHAR(20)), '/3","updatedAt":"2025-09-16"}}]}}}') AS body FROM pages""",
    "workable_page_fx": r"""
SELECT page_id, concat('tok', CAST(page_id % 50 AS VARCHAR(20))) AS token, 'Acme' AS company, concat('https://apply.workable.com/tok', CAST(page_id % 50 AS VARCHAR(20)), '/') AS url,
 concat(html, '<ul><li><a href="/tok', CAST(page_id % 50 AS VARCHAR(20)), '/j/A1/">Junior  <i>Developer</i></a><span class="x location">US-Remote</span></li>',
 '<li><a href="https://h.example.com/jobs/', CAST(page_id AS VARCHAR(20)), '">Data Engineer</a> <span>Remote OK</span></li><li><a href="/j/empty"> </a></li></ul>') AS html FROM pages""",
    "slug_page_fx": r"""
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'acme.co' ELSE 'beta' END AS token,
 concat(html, CASE page_id % 4 WHEN 0 THEN '<script>{"organizationSlug":"Acme-HQ","x":1}</script>' WHEN 1 THEN '<script>{"organization": {"id":1,"slug":"org-1"}}</script>' WHEN 2 THEN '<div data-organization-slug="beta"></div><div data-organization-slug="attr"></div>' ELSE '' END) AS html FROM pages""",
    "bare_postings_fx": r"""
SELECT seq, title, company, url, source, location, posted_at, CASE WHEN seq % 700 = 0 THEN description_snippet ELSE NULL END AS description_snippet, level FROM postings_fx""",
    "board_page_fx": r"""
SELECT page_id, concat('https://boards.example.com/', CASE page_id % 2 WHEN 0 THEN 'g' ELSE 'h' END, '/', CAST(page_id AS VARCHAR(20))) AS url, html FROM pages""",
    "gh_landed_fx": r"""
SELECT p.payload_id, concat('tok', CAST(p.company_id % 5 AS VARCHAR(20))) AS token, c.name AS company, p.body FROM gh_payload_fx p JOIN companies_fx c ON c.id = p.company_id""",
    "landed_fx": r"""
SELECT payload_id, CASE payload_id % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'ashby' END AS provider, concat('tok', CAST(company_id AS VARCHAR(20))) AS token, body FROM gh_payload_fx""",
    "board_directory_fx": r"""
SELECT ordinal, lower(ats) AS provider, company, token, CAST(NULL AS VARCHAR(20)) AS host, 'External' AS path, priority FROM directory_fx""",
    "junior_page_fx": r"""
SELECT page_id, concat('<p>', CASE page_id % 4 WHEN 0 THEN 'for a <b>recent</b> grad' WHEN 1 THEN '1 to 3 years<!-- junior -->' WHEN 2 THEN '<script>junior</script>' ELSE '' END, '</p>', html) AS html FROM pages""",
}
