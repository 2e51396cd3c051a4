"""Label lists, bin edges and thresholds of the CRM domain.

Fixed values: results are only right when these texts and numbers are exactly as written here.
"""

# --- enumerations -----------------------------------------------------------

INDUSTRIES = [
    "Technology", "Healthcare", "Finance", "Manufacturing", "Retail",
    "Education", "Real Estate", "Media", "Energy", "Transportation",
    "Telecommunications", "Hospitality", "Agriculture", "Automotive",
    "Pharmaceuticals", "Aerospace", "Consulting", "Insurance",
    "Legal Services", "Non-Profit",
]
DEAL_STAGES = [
    "Prospecting", "Qualification", "Proposal", "Negotiation", "Closed Won", "Closed Lost",
]
PIPELINES = ["Enterprise", "Mid-Market", "SMB", "Partner"]
LEAD_SOURCES = [
    "Organic Search", "Paid Search", "Social Media", "Email Marketing", "Direct Traffic",
    "Referral", "Content Marketing", "Events", "Partner", "Cold Outreach",
]
LIFECYCLE_STAGES = [
    "Subscriber", "Lead", "MQL", "SQL", "Opportunity", "Customer", "Evangelist",
]
CHANNELS = ["Organic", "Paid", "Social", "Email", "Direct", "Referral"]
CAMPAIGN_TYPES = [
    "Newsletter", "Product Launch", "Drip Campaign", "Re-engagement", "Seasonal Promotion",
    "Webinar Invite", "Case Study", "Feature Announcement", "Survey", "Onboarding",
]
EMAIL_ACTIONS = ["Sent", "Delivered", "Opened", "Clicked", "Bounced", "Unsubscribed", "Spam"]
TICKET_PRIORITIES = ["Critical", "High", "Medium", "Low"]
TICKET_CATEGORIES = [
    "Bug Report", "Feature Request", "Billing", "Integration", "Performance",
    "Security", "Onboarding", "Data Migration", "API Issue", "General Inquiry",
]
DEVICES = ["Desktop", "Mobile", "Tablet"]
PAGES = [
    "/", "/pricing", "/features", "/blog", "/contact", "/about", "/demo", "/docs", "/api",
    "/integrations", "/case-studies", "/careers", "/partners", "/resources", "/webinars",
    "/product/crm", "/product/marketing", "/product/sales", "/product/service", "/product/cms",
]

# --- bins: n+1 edges for n labels, each bin open below and closed above -------

REVENUE_EDGES = [0, 1_000, 10_000, 50_000, 200_000, 1_000_000, float("inf")]
REVENUE_LABELS = ["< $1K", "$1K–10K", "$10K–50K", "$50K–200K", "$200K–1M", "> $1M"]
EMPLOYEE_EDGES = [0, 10, 50, 200, 1000, 5000, float("inf")]
EMPLOYEE_LABELS = ["Micro", "Small", "Medium", "Large", "Enterprise", "Mega"]
GRADE_EDGES = [-1, 20, 40, 60, 80, 100]
GRADE_LABELS = ["F", "D", "C", "B", "A"]

# --- thresholds ---------------------------------------------------------------

REFERENCE_YEAR = 2025
FORM_SUBMISSION_WEIGHT = 10
ENGAGEMENT_CAP = 1000
ENGAGED_EVENT_SECONDS = 60
ENGAGED_SESSION_SECONDS = 30
SLA_HOURS = {"Critical": 4, "High": 24, "Medium": 72, "Low": 168}
TOP_COUNTRIES = 15
TOP_INDUSTRIES = 10
FUNNEL_MIN_WIDTH = 8
SLA_GOOD = 70
SLA_WARNING = 50
