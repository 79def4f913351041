"""Vocabularies of appraisal documents, as fixed values."""

# ---- fixed values: section subtypes in the order they are tried, their groups, required subtypes ----
SECTION_TYPES: dict[str, list[str]] = {
    "datasheet": ["^datasheet$"],
    "strategic_context": ["^strategic context$"],
    "country_context": ["^(country|regional) context$", "^context$", "^(program|project) strategic context$"],
    "sectoral_context": ["sectoral and institutional context"],
    "higher_level_objectives": ["relevance to higher[- ]level objectives"],
    "description": ["^(program|project) description$"],
    "development_objective": ["development objective"],
    "theory_of_change": ["theory of change", "^results chain"],
    "beneficiaries": ["beneficiaries"],
    "components": ["components$", "program scope"],
    "disbursement_linked_indicators": ["disbursement linked indicators"],
    "partners": ["role of partners"],
    "lessons_learned": ["lessons learned", "global lessons"],
    "citizen_engagement": ["citizen engagement"],
    "institutional_arrangements": ["^institutional and implementation arrangements$"],
    "implementation": ["^(program|project) implementation$", "^implementation arrangements$"],
    "results_monitoring": ["results monitoring"],
    "disbursement_arrangements": ["disbursement arrangements"],
    "sustainability": ["^sustainability$"],
    "appraisal_summary": ["appraisal summary", "assessments summary"],
    "technical_analysis": ["^technical"],
    "economic_analysis": ["economic and financial analysis", "^economic analysis"],
    "fiduciary": ["^fiduciary$", r"^fiduciary\b"],
    "environmental_social": ["^environmental(,| and) social", r"^e&s\b"],
    "legal_policies": ["legal operational policies"],
    "corporate_requirements": ["corporate requirements"],
    "paris_alignment": ["paris"],
    "gender": ["^gender$"],
    "ipf_appraisal": ["ipf appraisal", "investment project financing component"],
    "action_plan": ["action plan"],
    "grievance_redress": ["grievance redress"],
    "key_risks": ["key risks", "^risks$"],
    "results_framework": ["results framework", "^pdo indicators$"],
    "implementation_support": ["implementation support", "implementation arrangements and support plan"],
    "mpa_framework": ["multiphase programmatic approach", "participating countries"],
    "mpa_phase": ["^mpa phase"],
}
SECTION_GROUPS: dict[str, list[str]] = {
    "overview": ["datasheet"],
    "context": ["strategic_context", "country_context", "sectoral_context", "higher_level_objectives"],
    "pdo": ["development_objective"],
    "design": ["description", "theory_of_change", "beneficiaries", "components", "disbursement_linked_indicators", "partners", "citizen_engagement"],
    "lessons": ["lessons_learned"],
    "implementation": ["implementation", "institutional_arrangements", "results_monitoring", "disbursement_arrangements", "sustainability", "implementation_support"],
    "appraisal": ["appraisal_summary", "technical_analysis", "economic_analysis", "fiduciary", "environmental_social", "legal_policies", "corporate_requirements", "paris_alignment", "gender", "ipf_appraisal", "action_plan", "grievance_redress"],
    "risks": ["key_risks"],
    "results": ["results_framework"],
    "mpa": ["mpa_framework", "mpa_phase"],
}
CORE = ["datasheet", "development_objective", "lessons_learned", "key_risks", "results_framework"]
# ---------------------------------------------------------------------------------------------------
