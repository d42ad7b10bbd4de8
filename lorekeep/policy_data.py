"""The default policy. Command prefixes, pairs that are never allowed, and levels, one a line."""

DENY_LEVEL = "R2"
CONFIRM_TTL_SECONDS = 300
LEVELS = {
    "R0": {"auto": True, "needs_confirm": False, "human_only": False},
    "R1": {"auto": False, "needs_confirm": True, "human_only": False},
    "R2": {"auto": False, "needs_confirm": True, "human_only": False},
    "R3": {"auto": False, "needs_confirm": True, "human_only": True},
}
NEVER = """
auth export
auth import
auth logout
auth reset
"""
WHITELIST = """
chat message list
chat message list-all
chat message list-by-ids
chat message list-by-sender
chat message list-focused
chat message list-mentions
chat message list-topic-replies
chat message list-unread-conversations
chat message query-send-status
chat message read-status
chat message search
chat message search-advanced
chat search
chat search-common
chat conversation-info
chat list-top-conversations
chat group list-my-groups
chat group get-by-group-id
chat group members
chat group member-role
chat group invite-url
oa approval list-pending
oa approval list-cc
oa approval list-executed
oa approval list-forms
oa approval list-initiated
oa approval list-submitted
oa approval detail
oa approval records
oa approval tasks
todo list
todo task list
todo task get
calendar event list
calendar event get
calendar busy
calendar room
doc read
doc search
doc list
doc info
doc download
doc export
report inbox
report inbox-list
report outbox
report outbox-list
report list
report detail
report get
report stats
report sent
report template-list
report template-get
report created
minutes list
minutes get
minutes record
minutes speaker
minutes hot-word
minutes mind-graph
contact search
contact search-mobile
contact get
contact get-self
contact list
contact profile
contact dept
contact label
contact relation
drive list
drive list-spaces
drive info
drive download
aitable list
aitable info
aitable record list
aitable record get
aitable record query
aitable field
aitable view
mail mailbox
mail message get
mail message search
mail folder
mail thread
"""
RULES = """
R3 chat message send
R3 chat message send-by-bot
R3 chat message send-by-webhook
R3 chat message send-card
R3 chat message reply
R3 chat message forward
R3 chat message combine-forward
R3 ding send
R3 ding message send
R3 mail send
R3 mail message send
R3 mail message reply
R3 mail message reply-all
R3 mail message forward
R3 oa approval approve
R3 oa approval reject
R3 oa approval redirect-task
R2 chat message recall
R2 chat message recall-by-bot
R2 chat message update-card
R2 chat group dismiss
R2 chat group quit
R2 chat group set-admin
R2 chat group transfer-owner
R2 chat group set-history
R2 chat group-mute
R2 chat group-mute-member
R2 ding message recall
R2 oa approval revoke
R2 doc delete
R2 doc move
R2 doc permission
R2 drive delete
R2 minutes replace-text
R2 minutes permission
R2 aitable delete
R2 aitable record delete
R2 mail message batch-delete
R2 todo task delete
R2 calendar event delete
R1 todo task create
R1 todo create
R1 calendar event create
R1 aitable record create
R1 report submit
R1 report create
R1 doc create
R3 auth
"""


def default_policy() -> dict:
    """The policy as its file would parse."""
    return {
        "defaults": {"deny_level": DENY_LEVEL, "confirm_ttl_seconds": CONFIRM_TTL_SECONDS},
        "levels": LEVELS,
        "never": [line.split() for line in NEVER.split("\n") if line],
        "r0_whitelist": [{"match": line.split()} for line in WHITELIST.split("\n") if line],
        "rules": [{"level": line.split()[0], "prefix": line.split()[1:]} for line in RULES.split("\n") if line],
    }
