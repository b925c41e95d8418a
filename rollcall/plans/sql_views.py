"""The reference's named reports as Spark SQL temp views, so a user can keep
querying them by name (``SELECT ... FROM dashboard_stats WHERE ...``).
Each view is the DataFrame operator; filters in the user's query are pushed
through it by Catalyst."""

from __future__ import annotations

from ..operators import billing, reports
from ..sources.views import Domain


def register_report_views(dom: Domain, as_of: str | None = None) -> list[str]:
    """Register visitor_summary, dashboard_stats, event_stats,
    tenant_analytics, tenant_subscription (latest plan with last payment)
    and tenant_limits (usage against plan limits at ``as_of``, default now)."""
    dom.register()
    views = {
        "visitor_summary": reports.visitor_summary(dom.visitors, dom.categories, dom.occasions,
                                                   dom.checkins),
        "dashboard_stats": reports.dashboard_stats(dom.occasions, dom.visitors, dom.categories,
                                                   dom.checkins),
        "event_stats": reports.event_stats(dom.occasions, dom.visitors, dom.categories),
        "tenant_analytics": reports.tenant_analytics(dom.tenants, dom.subscriptions, dom.plans,
                                                     dom.occasions, dom.visitors, dom.checkins,
                                                     dom.staff),
        "tenant_subscription": billing.subscription_with_last_payment(dom.subscriptions, dom.plans,
                                                                      dom.payments),
        "tenant_limits": billing.plan_usage(dom.tenants, dom.subscriptions, dom.plans,
                                            dom.occasions, dom.staff, dom.visitors, as_of),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
