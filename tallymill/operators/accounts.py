"""How far people have come in signing up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.functions.text import strip

# Stages and what comes next.
NEXT = {
    "user_exists_unverified": "verify_email",
    "fully_active": "login",
    "signed_up_pending_verification": "verify_email",
    "email_verified_pending_tenant_setup": "setup_tenant",
    "invited_pending_registration": "register_with_invite",
    "not_signed_up": "register",
}


def stages(emails: DataFrame, users: DataFrame, signups: DataFrame, invitations: DataFrame) -> DataFrame:
    """stage and next_action of each email: a user comes before a signup, that before the newest invitation that is valid.

    users: email, email_verified; signups: email, is_verified, pending (the verification has not run out);
    invitations: id, email, valid. A missing flag counts as false.
    """
    key = F.lower(strip(F.col("email")))
    flag = lambda c: F.coalesce(c, F.lit(False))
    u = users.groupBy(key.alias("email")).agg(F.max(flag(F.col("email_verified"))).alias("user"))
    s = signups.groupBy(key.alias("email")).agg(F.max(flag(F.col("is_verified") & F.col("pending"))).alias("signup"))
    i = invitations.where(flag(F.col("valid"))).groupBy(key.alias("email")).agg(F.max("id").alias("invitation_id"))
    rows = emails.select(key.alias("email")).join(u, "email", "left").join(s, "email", "left").join(i, "email", "left")
    stage = (
        F.when(F.col("user"), "fully_active").when(~F.col("user"), "user_exists_unverified").when(F.col("signup"), "email_verified_pending_tenant_setup")
        .when(~F.col("signup"), "signed_up_pending_verification").when(F.col("invitation_id").isNotNull(), "invited_pending_registration").otherwise("not_signed_up")
    )
    actions = F.create_map(*[F.lit(x) for pair in NEXT.items() for x in pair])
    invited = F.when(stage == "invited_pending_registration", F.col("invitation_id"))
    return rows.select("email", stage.alias("stage"), actions[stage].alias("next_action"), invited.alias("invitation_id"))
