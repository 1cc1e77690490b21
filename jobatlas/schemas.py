"""Table schemas of the job-market model, as DDL text."""

RAW_POSTING = (
    "id string, source string, url string, title string, company string, region_raw string, salary_raw string, "
    "experience_raw string, posted_date_raw string, description string, skills array<string>, crawled_at string"
)
SKILL = "struct<name:string,level:string,source_quote:string>"
EXPERIENCE = "struct<title:string,kind:string,description:string,skills:array<string>,source_quote:string>"
CONSTRAINTS = "struct<region_pref:string,study_budget:string,study_duration_pref:string,notes:string>"
QUOTE = "struct<turn:int,quote:string,mapped_to:string>"
ROUTE = "struct<type:string,label:string,detail:string,first_steps:array<string>>"
PROFILE = (
    "session_id string, journey_mode string, education_stage string, job_goal string, dimensions map<string,double>, "
    f"skills array<{SKILL}>, interests array<string>, constraints {CONSTRAINTS}, evidence_quotes array<{QUOTE}>, "
    f"experiences array<{EXPERIENCE}>, completeness double"
)
CAREER = (
    "career_id string, title string, description string, title_patterns array<string>, "
    f"entry_role_aliases array<string>, dimensions map<string,double>, routes array<{ROUTE}>, "
    "skill_roadmap array<struct<skill:string,status:string>>"
)
TAXONOMY = "name string, aliases array<string>, type string"
GOLD = "posting_id string, region string, career_group string, skills array<string>"
TURN = "session_id string, turn long, journey_mode string, text string"
