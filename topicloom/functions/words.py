"""Word lists."""

# --- fixed values: words that say nothing of a topic ---
SEED_STOPWORDS = (
    "research project study studies program proposal proposed investigate investigator investigators award grant funding "
    "support supported develop understanding approach goal goals objective objectives aim aims work results provide "
    "provides new novel important significant student students education educational broader impact impacts activities "
    "pi pis co nsf nih university universities northeastern foundation department "
    "future topics topic explore fundamental national level levels availability intellectual merit practice guidelines"
).split()

# --- fixed values: words that are never stopped ---
PROTECTED = (
    "data systems system science development model models information materials design control network networks "
    "analysis methods method structure structures cell cells gene genes protein proteins software algorithm algorithms "
    "energy molecular quantum learning computing"
).split()

# --- fixed values: kinds of a record, and those that are kept ---
KINDS = (
    "research tool_or_infrastructure evaluation_research training conference_or_travel education_or_curriculum "
    "outreach_or_broadening_participation economic_development other"
).split()
KEPT_KINDS = ["research", "tool_or_infrastructure", "evaluation_research"]
